"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import materialize


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them. Links run from the larger to the smaller node."""
    least = _least(links)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (u, v); component is the least node that links reach.

    Minima are aggregated before they move and the joins are plain equi-joins
    that adaptive execution splits, so a node with very many links is no single
    task. Each round is written to the shared folder. Rounds grow with the
    logarithm of the longest chain. Self-links and repeated links change
    nothing; no links give no rows.
    """
    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # a table of links is settled when a round returns it: each node then hangs on the least of its component
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        now = materialize(_small(_large(now).distinct()).distinct())
