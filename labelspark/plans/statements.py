"""Rows of a table as SQL statements of limited length, filled one after another.

A statement takes rows in their order until the next one would make it too long
or too many, so where one begins depends on where all before it did. Rows are
numbered over all, in blocks, and a block is a function: for each of its first
rows at which a statement may begin, it tells at which of the next block's rows
the statement after its own begins, and how many begin in it. Functions of
neighbouring blocks are composed in groups, groups in groups of groups, and the
one beginning that holds, that of row 0, is handed down again. No task reads
more than a block of rows or a group of functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.sources.shared import materialize

# Limits of one insert statement.
MOST_CHARS, MOST_ROWS = 25_000, 200
#: Rows of a block, at least MOST_ROWS, and blocks whose functions are composed in one task.
BLOCK, FAN = 4096, 256
_FUNCTION = "b long, entry long, exit long, n long"


def numbered(rows: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """rows with whole-number ids from 1 by the order of their keys, without a task that sorts all rows.

    Rows are written in range partitions, and the sizes of the partitions before
    are added: as many counts as there are partitions.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_m") - F.shiftleft("_p", 33)
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + inside + 1).cast("long")).drop("_p", "_m", "_start")


def literal(c: Column, is_number: bool) -> Column:
    """A value as SQL: numbers bare, quotes doubled, NULL."""
    text = c.cast("string")
    return F.coalesce(text if is_number else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def next_starts(lengths: np.ndarray) -> np.ndarray:
    """For each row the one after the statement that begins there."""
    ends = np.cumsum(lengths + 2)
    begins = ends - lengths - 2
    too_long = np.searchsorted(begins + lengths, begins + MOST_CHARS, side="right")
    return np.minimum(np.maximum(too_long, np.arange(len(lengths)) + 1), np.arange(len(lengths)) + MOST_ROWS)


def _function(rows: pd.DataFrame) -> pd.DataFrame:
    """A block, with the first rows of the next one behind its own: from each row at which a statement may enter to the next block's."""
    rows = rows.sort_values("i")
    after, own = next_starts(rows["len"].to_numpy()), int(rows["own"].sum())
    exits, n = np.arange(own, own + MOST_ROWS + 1), np.zeros(own + MOST_ROWS + 1, np.int64)
    exits = np.r_[np.zeros(own, np.int64), exits]
    for k in range(own - 1, -1, -1):
        exits[k], n[k] = exits[after[k]], n[after[k]] + 1
    entry = np.arange(MOST_ROWS)
    return pd.DataFrame({"b": rows["b"].iloc[0], "entry": entry, "exit": exits[entry] - own, "n": n[entry]})


def _tables(rows: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = rows.sort_values(["b", "entry"])
    return [(b, x["exit"].to_numpy(), x["n"].to_numpy()) for b, x in rows.groupby("b", sort=True)]


def _composed(rows: pd.DataFrame, fan: int) -> pd.DataFrame:
    """Functions of neighbours as one."""
    at, n = np.arange(MOST_ROWS), np.zeros(MOST_ROWS, np.int64)
    for _, exits, more in _tables(rows):
        n, at = n + more[at], exits[at]
    return pd.DataFrame({"b": rows["b"].min() // fan, "entry": np.arange(MOST_ROWS), "exit": at, "n": n})


def _handed_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Where statements enter each of the neighbours, and how many have begun before, from the same of all of them (at, before)."""
    at, before, out = int(rows["at"].iloc[0]), int(rows["before"].iloc[0]), []
    for b, exits, n in _tables(rows):
        out.append((b, at, before))
        at, before = int(exits[at]), before + int(n[at])
    return pd.DataFrame(out, columns=["b", "at", "before"])


def _entries(functions: DataFrame, blocks: int) -> DataFrame:
    """(b, at, before) of each block: the row of it at which the first statement of its own begins, and statements begun before."""
    levels, fan = [functions], FAN
    while blocks > 1:
        blocks = -(-blocks // fan)
        levels.append(materialize(levels[-1].withColumn("g", F.floor(F.col("b") / fan)).groupBy("g").applyInPandas(lambda rows: _composed(rows, fan), _FUNCTION)))
    found = functions.sparkSession.range(1).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    for level in levels[-2::-1]:
        inside = level.withColumn("g", F.floor(F.col("b") / fan)).join(found.withColumnRenamed("b", "g"), "g")
        found = inside.groupBy("g").applyInPandas(_handed_down, "b long, at long, before long")
    return found


def _statement_of_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's rows with the number of their statement; the same rows as for its function."""
    rows = rows.sort_values("i")
    after, own = next_starts(rows["len"].to_numpy()), int(rows["own"].sum())
    starts, k = np.zeros(own + 1, np.int64), int(rows["at"].iloc[0])
    while k < own:
        starts[k], k = 1, int(after[k])
    return pd.DataFrame({"i": rows["i"].to_numpy()[:own], "batch": int(rows["before"].iloc[0]) + np.cumsum(starts[:own]) - 1})


def insert_batches(df: DataFrame, table: str, order: str) -> DataFrame:
    """(batch, n_rows, statement): rows by `order`, as many in each statement as fit into MOST_CHARS characters, counted as the rows' and two for each, and MOST_ROWS; a longer row stands alone."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    row = F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(c), c in numeric) for c in df.columns]), F.lit(")"))
    rows = numbered(df.select(F.col(order).alias("_order"), row.alias("_r")), ["_order"]).select((F.col("id") - 1).alias("i"), "_r", F.floor((F.col("id") - 1) / BLOCK).alias("b"))
    lengths = rows.select("b", "i", F.length("_r").cast("long").alias("len"), F.lit(1).alias("own"))
    ahead = lengths.filter((F.col("i") % BLOCK < MOST_ROWS) & (F.col("b") > 0)).withColumns({"b": F.col("b") - 1, "own": F.lit(0)})
    reads = lengths.unionByName(ahead)
    blocks = -(-rows.count() // BLOCK)
    if blocks:
        entries = _entries(materialize(reads.groupBy("b").applyInPandas(_function, _FUNCTION)), blocks)
        numbers = reads.join(entries, "b").groupBy("b").applyInPandas(_statement_of_rows, "i long, batch long")
    else:
        numbers = rows.select("i", F.lit(0).cast("long").alias("batch"))
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES\n"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_r"))), lambda x: x["_r"]), ",\n")
    out = rows.select("i", "_r").join(numbers, "i").groupBy("batch").agg(F.count("*").alias("n_rows"), text.alias("_v"))
    return out.select("batch", "n_rows", F.concat(F.lit(head), "_v", F.lit(";")).alias("statement"))
