"""Sharding by sampled splitters: shards of near equal bytes, equal texts together.

Records are keyed by the digest and size of their text, so a group of equal
texts is one key. Keys are drawn in proportion to the bytes of their records
(and to their number, so that masses of short texts are seen too). The sample
gives two things:

* the keys that may hold more than a LARGE-th of all bytes or rows. They are
  counted exactly, are at most 2 * LARGE, and are dealt out largest first to the
  emptiest shard: whole where they fit in, else in pieces that fill it up.
* quantile boundaries of all other keys. Records are partitioned by them into
  ranges, a range that holds too many rows is subdivided evenly, and the ranges'
  bytes are summed up, so every key has its exact place on a line of bytes. The
  room that the large keys leave in each shard is its share of that line, and a
  key belongs to the shard in whose share its middle lies.

The sample decides how even the work is; sizes and places are counted. Shards
differ by no more than a large key's least size, some hundredth of a shard,
unless a single document is larger. Slots are ranks: first in a shard come its
pieces of large keys, then its part of the line. Ranks of a large key's rows are
counted in buckets of a hash, and a bucket that a repeated document fills is
divided again, so no task holds a key, a range or a shard. Only built-in
functions run, on ids, sizes and hashes; the texts are read once.

Defined results: every row comes out once. A null text has no bytes, like an
empty one, and belongs to the group of empty texts; a row without doc_id is a
row like others; equal rows get different slots; ties of place end in doc_id,
equal rows arbitrarily; shards may stay empty where rows are few; an empty table
gives an empty table. Other columns are not read, or carried along under their
own names.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.llm.common import materialize

SHARDS, LAW = 16, "bytes"
#: Of how many equal parts of all bytes or rows, for each shard, a key must hold one to be large, and how often such a key is drawn on average.
LARGE, DRAWN = 128, 16
#: Rows that a cell is meant to hold, and ranges that splitters part.
CELL, RANGES = 1024, 256
_PIECES = "u int, k long, size long, rows long, froms array<long>, at array<int>, bases array<long>"


def allot(large: list[tuple[int, int, int]], rest: int, shards: int) -> tuple[list[tuple[list[int], list[int], list[int]]], list[int], list[int]]:
    """Places of large keys (k, size, rows), when rest bytes are still to come: for each key the ranks at which its pieces begin, their shards and first slots; rows and bytes of each shard."""
    left, free = rest + sum(size * rows for _, size, rows in large), shards
    for size, rows in sorted(((size, rows) for _, size, rows in large), reverse=True):
        for _ in range(rows):
            if free == 1 or size * free < left:
                break
            left, free = left - size, free - 1  # a document larger than what is left for each of the others
    loads, held = [0] * shards, [0] * shards
    emptiest = [(0, s) for s in range(shards)]
    places: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in large]
    for u in sorted(range(len(large)), key=lambda u: (large[u][1] * free < left, -large[u][1] * large[u][2], large[u][0], large[u][1])):
        _, size, rows = large[u]
        done = 0
        while done < rows:
            load, s = heapq.heappop(emptiest)
            take = min(rows - done, max(1, (left - load * free) // (size * free)))
            for x, value in zip(places[u], (done, s, held[s]), strict=True):
                x.append(value)
            done, held[s], loads[s] = done + take, held[s] + take, load + take * size
            heapq.heappush(emptiest, (loads[s], s))
    return places, held, loads


def borders(loads: list[int], rest: int) -> list[int]:
    """Where, in half bytes of the line of rest bytes, each shard but the first begins, if all are filled to one level."""
    low, level = 0, Fraction(0)
    for n, load in enumerate(sorted(loads), 1):
        low += load
        level = Fraction(rest + low, n)
        if n == len(loads) or level <= sorted(loads)[n]:
            break
    out, at = [], Fraction(0)
    for load in loads[:-1]:
        at += max(Fraction(0), level - load)
        out.append(-(-2 * at.numerator // at.denominator))
    return out


def _place(of: Column, ends: list[int], low: int = 0) -> Column:
    """How many of the sorted ends are at most as large, by halving."""
    if not ends:
        return F.lit(low)
    half = len(ends) // 2
    return F.when(of < F.lit(ends[half]), _place(of, ends[:half], low)).otherwise(_place(of, ends[half + 1 :], low + half + 1))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Few rows of the driver as a table, which is broadcast."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def _uniform(digits: Column) -> Column:
    """0 to 1, from the first eight hex digits."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _at(numbers: list[int], index: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>"), (index + 1).cast("int"))


def _starts(cells: DataFrame, within: str, *order: str) -> DataFrame:
    """Cells with the rows and bytes of those before them."""
    before = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(within, *order, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "bytes")])


def _large_rows(rows: DataFrame, total_rows: int) -> DataFrame:
    """Rows of large keys, which have their key's pieces, with shard and slot."""
    bucket = F.floor(_uniform(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))) * F.ceil(F.col("rows") / CELL)).cast("long")
    rows = rows.withColumn("q", bucket)
    sums = [F.count("*").alias("rows"), F.sum("size").alias("bytes")]
    # a document that is there very often, all in one bucket: fewer than 4096 such buckets
    full = rows.groupBy("u", "q").agg(*sums).filter((F.col("rows") > 2 * CELL) & (F.col("rows") * 4096 > total_rows)).select("u", "q", F.ceil(F.col("rows") / CELL).alias("_parts"))
    rows = rows.join(F.broadcast(full), ["u", "q"], "left").withColumn("q2", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_parts")), F.lit(0))).drop("_parts")
    starts = _starts(rows.groupBy("u", "q", "q2").agg(*sums), "u", "q", "q2").select("u", "q", "q2", "rows_before")
    nth = F.row_number().over(Window.partitionBy("u", "q", "q2").orderBy("doc_id", "row")) - 1
    ranked = rows.withColumn("nth", nth).join(starts.hint("shuffle_hash"), ["u", "q", "q2"]).withColumn("rank", F.col("nth") + F.col("rows_before"))
    piece = F.size(F.filter("froms", lambda x: x <= F.col("rank")))
    return ranked.withColumns({"shard": F.element_at("at", piece), "slot": F.element_at("bases", piece) + F.col("rank") - F.element_at("froms", piece)})


def shard_documents(documents: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """Each row's (doc_id, size, text_crc32, law, shard, slot, grown_shard); size is the text's bytes and one, slot gapless from 0 in its shard, grown_shard null under this law.

    carry: with all columns of documents, those of the same names left out.
    """
    if shards < 1:
        raise ValueError(f"at least one shard: {shards}")
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    other = {f"c{j}": c for j, c in enumerate(documents.columns) if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")} if carry else {}
    own = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k")
    rows = materialize(documents.select(*own, key, F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(x) for x, c in other.items()]))
    total_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    large_from = LARGE * shards

    weight = F.greatest(F.col("size") / F.lit(float(max(total, 1))), F.lit(1 / max(total_rows, 1))) * (large_from * DRAWN)
    drawn = rows.withColumn("w", weight).filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 40)) / F.lit(2.0**40) < F.col("w")).groupBy("k", "size").agg(F.sum(F.greatest("w", F.lit(1.0))).alias("w"))
    # as many as were to be drawn, whatever the table
    sample = sorted((r.k, r.size, r.w) for r in drawn.collect())
    counted = rows.join(_table(spark, [{"k": k, "size": size} for k, size, _ in sample], "k long, size long"), ["k", "size"]).groupBy("k", "size").agg(F.count("*").alias("rows"))
    n = F.col("rows") * large_from
    large = sorted((r.k, r.size, r.rows) for r in counted.filter((n * F.col("size") >= total) | (n >= total_rows)).collect())
    rest_rows, rest = total_rows - sum(r for _, _, r in large), total - sum(size * r for _, size, r in large)
    places, held, loads = allot(large, rest, shards)
    keys = [{"u": u, "k": k, "size": size, "rows": r, "froms": places[u][0], "at": places[u][1], "bases": places[u][2]} for u, (k, size, r) in enumerate(large)]
    marked = rows.join(_table(spark, keys, _PIECES), ["k", "size"], "left")
    columns = ["doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    columns += [F.col(x).alias(c) for x, c in other.items()]
    out = _large_rows(marked.filter("u is not null"), total_rows).select(*columns)
    return out.unionByName(_line(marked.filter("u is null").drop("u", "rows", "froms", "at", "bases"), sample, set((k, size) for k, size, _ in large), rest, rest_rows, held, loads).select(*columns))


def _line(rows: DataFrame, sample: list[tuple[int, int, float]], large: set[tuple[int, int]], rest: int, rest_rows: int, held: list[int], loads: list[int]) -> DataFrame:
    """The rows of no large key, with shard and slot: rest bytes in all, behind what the shards hold."""
    spark = rows.sparkSession
    seen = [(k, w) for k, size, w in sample if (k, size) not in large]
    ranges, weight, at, ends = max(1, min(RANGES, rest_rows // CELL)), sum(w for _, w in seen), 0.0, []
    for k, w in seen:
        if at >= weight * (len(ends) + 1) / ranges and len(ends) < ranges - 1 and (not ends or k > ends[-1]):
            ends.append(k)
        at += w
    rows = rows.withColumn("r", _place(F.col("k"), ends))
    sums = [F.count("*").alias("rows"), F.sum("size").alias("bytes")]
    found = {r.r: (r.rows, r.bytes) for r in rows.groupBy("r").agg(*sums).collect()}
    ranged, edges, rows_at, bytes_at = [], [0, *ends, 1 << 60], 0, 0
    for r in range(len(ends) + 1):
        n, b = found.get(r, (0, 0))
        # an overfull range is subdivided evenly, as its keys are digests
        ranged.append({"r": r, "low": edges[r], "width": edges[r + 1] - edges[r], "parts": max(1, -(-n // CELL)), "range_rows": rows_at, "range_bytes": bytes_at})
        rows_at, bytes_at = rows_at + n, bytes_at + b
    ranged_table = _table(spark, ranged, "r int, low long, width long, parts long, range_rows long, range_bytes long")
    part = F.least(F.floor((F.col("k") - F.col("low")) / F.col("width") * F.col("parts")), F.col("parts") - 1).cast("long")
    rows = rows.join(ranged_table, "r").withColumn("q", part).drop("low", "width", "parts")
    starts = _starts(rows.groupBy("r", "q").agg(*sums), "r", "q")
    cell, group = Window.partitionBy("r", "q"), Window.partitionBy("r", "q", "k", "size")
    order = ("doc_id", "row")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumns({
        "nth": F.row_number().over(group.orderBy(*order)) - 1,
        "copies": F.count("*").over(whole),
        "index": F.row_number().over(cell.orderBy("k", "size", *order)) - 1,
        "sum": F.sum("size").over(cell.orderBy("k", "size", *order).rowsBetween(Window.unboundedPreceding, 0)),
    }).join(starts.hint("shuffle_hash"), ["r", "q"])
    before = F.col("range_bytes") + F.col("bytes_before") + F.col("sum") - F.col("size") * (F.col("nth") + 1)
    middle = 2 * before + F.col("size") * F.col("copies")
    placed = placed.withColumns({"shard": _place(middle, borders(loads, rest)), "index": F.col("range_rows") + F.col("rows_before") + F.col("index")})
    placed = materialize(placed.drop("r", "q", "k", "row", "nth", "copies", "sum", "range_rows", "range_bytes", "rows_before", "bytes_before"))
    counts = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    ahead, at_row = [], 0
    for s in range(len(loads)):
        ahead.append(held[s] - at_row)
        at_row += counts.get(s, 0)
    return placed.withColumn("slot", F.col("index") + _at(ahead, F.col("shard")))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of the documents under path, a folder shard=s for each shard, in the order of the slots."""
    rows = shard_documents(documents, shards, carry=True).drop("law", "grown_shard")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
