"""Mixing sources to target weights by Pfair scheduling.

Weights become whole numbers: as they are while a table of one period holds at
most ENTRIES numbers (two sources may be as unequal as a million to one, twenty
as 190 000 to one), else shares of the longest such period, the largest
remainders rounded up, none below one. Their sum D is the period. Block j (from
1) of a source of weight a is released at slot floor((j - 1) D / a) and due by
ceil(j D / a). Earliest deadline first over the released blocks fills each slot
and meets all deadlines, so after any number of slots a source has had its
share but for less than one block. The schedule repeats after D slots, each
source having had exactly a of them; so a table of D slots, which depends on
the weights alone and is broadcast, gives every block its slot.

Every row gets its rank within its source (by a hash of its doc_id, or of its
text where it has none) without any
task that holds a source: rows are counted in buckets of the hash, the counts
are summed up, and ranks inside a bucket are added. Only built-in functions run.

Defined results: every row comes out once. A negative or non-finite weight is
an error, a source of weight zero has none. A source that runs out leaves its
slots, and the others keep their proportions. Rows whose source is null or has
no weight follow all others, ordered by the same hash. Rows that repeat a
doc_id are ordered by their texts' hash, equal rows arbitrarily; rows without
doc_id are ordered by the hash of their texts. An empty table gives an empty table. Other columns
are carried along under their own names, which may be any but those added.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.llm.common import materialize

#: Documents of a block.
BLOCK = 16
#: Rows that a bucket is meant to hold, and buckets whose counts are summed in one piece.
BUCKET, PIECE = 1024, 4096
#: Numbers that the table of a period may hold: a row for each slot, with a count for each source.
ENTRIES = 1 << 22


def longest_period(sources: int) -> int:
    return ENTRIES // (sources + 2)


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights above zero as whole numbers by source, in the sources' order."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError(f"weights are finite and not negative: {weights}")
    own = {s: Fraction(weights[s]) for s in sorted(weights) if weights[s] > 0}
    longest = longest_period(len(own))
    if len(own) > longest:
        raise ValueError(f"at most {longest} of {len(own)} sources can have a weight")
    total = sum(own.values())
    if all(w.denominator == 1 for w in own.values()):
        common = math.gcd(*map(int, own.values())) if own else 1
        if total / common <= longest:
            return {s: int(w) // common for s, w in own.items()}
    # the least period that gives all shares exactly as written, else the longest
    exact = {s: (w / total).limit_denominator(longest) for s, w in own.items()}
    period = math.lcm(*(w.denominator for w in exact.values()))
    if sum(exact.values()) == 1 and period <= longest and all(abs(w - own[s] / total) < Fraction(1, 10**12) for s, w in exact.items()):
        return {s: int(w * period) for s, w in exact.items()}
    parts = {s: max(1, int(w / total * longest)) for s, w in own.items()}
    for s in sorted(own, key=lambda s: (int(own[s] / total * longest) - own[s] / total * longest, s))[: max(0, longest - sum(parts.values()))]:
        parts[s] += 1
    return parts


def schedule(weights: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first over released blocks, ties to the earlier source."""
    period = sum(weights)
    ready: list[tuple[int, int, int]] = []
    releases: dict[int, list[tuple[int, int, int]]] = {}
    for i, a in enumerate(weights):
        for j in range(1, a + 1):
            releases.setdefault((j - 1) * period // a, []).append((-(-j * period // a), i, j))
    out = []
    for slot in range(period):
        for block in releases.get(slot, ()):
            heapq.heappush(ready, block)
        due, i, _ = heapq.heappop(ready)
        assert slot < due
        out.append(i)
    return out


def order_key(doc_id: Column, text: Column | None = None) -> Column:
    """Hex digits by which the rows of a source are shuffled."""
    without = F.lit("") if text is None else F.concat(F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.md5(F.coalesce(doc_id.cast("string"), without).cast("binary"))


def _case(of: Column, values: dict, otherwise) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(of == k, v) if out is None else out.when(of == k, v)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def _period_table(spark: SparkSession, slots: list[int], sources: int) -> DataFrame:
    """(_g, _j, _t, _before) of one period: the slot of each source's block j, and the blocks of all sources before it."""
    table = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, slots))), ",")).alias("_t", "_g")).select(F.col("_t").cast("long").alias("_t"), F.col("_g").cast("int").alias("_g"))
    before = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.array(*[F.coalesce(F.count(F.when(F.col("_g") == k, 1)).over(before), F.lit(0)) for k in range(sources)])
    counted = table.withColumn("_before", counts)
    return materialize(counted.select("_g", F.element_at("_before", F.col("_g") + 1).alias("_j"), "_t", "_before"))


def mix(documents: DataFrame, weights: dict[str, float], block: int = BLOCK, carry: bool = True) -> DataFrame:
    """Each row with block (from 0, within its source), slot (null without a weight) and position (from 0, without gaps).

    carry: with all columns of documents, else only doc_id and source.
    """
    parts = whole_weights(weights)
    sources, numbers = list(parts), list(parts.values())
    period = sum(numbers)
    slots = schedule(numbers)

    text = F.col("text") if "text" in documents.columns else None
    rows = documents if carry else documents.select("doc_id", "source", *(["text"] if text is not None else []))
    buckets = -(-documents.count() // BUCKET)
    group = _case(F.col("source"), {s: k for k, s in enumerate(sources)}, len(sources))
    key = order_key(F.col("doc_id"), text)
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(max(buckets, 1)).cast("long") / F.lit(2**32)).cast("long")
    rows = rows.withColumns({"_g": group, "_k": key, "_b": bucket, "_x": F.lit(0) if text is None else F.xxhash64(text)})
    rows = rows if carry else rows.select("doc_id", "source", "_g", "_k", "_b", "_x")
    columns = documents.columns if carry else ["doc_id", "source"]
    counts = documents.select(group.alias("_g"), bucket.alias("_b")).groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    # in two levels, so that no task sums all buckets of a source
    piece = F.floor(F.col("_b") / PIECE).alias("_q")
    pieces = counts.groupBy("_g", piece).agg(F.sum("_n").alias("_n"))
    before_piece = pieces.select("_g", "_q", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_q")) - F.col("_n")).alias("_before"))
    inner = F.sum("_n").over(Window.partitionBy("_g", "_q").orderBy("_b")) - F.col("_n")
    starts = counts.select("*", piece).select("_g", "_b", "_q", inner.alias("_inner")).join(before_piece, ["_g", "_q"]).select("_g", "_b", (F.col("_inner") + F.col("_before")).alias("_start"))
    totals = {r[0]: r[1] for r in counts.groupBy("_g").agg(F.sum("_n")).collect()}

    inside = Window.partitionBy("_g", "_b").orderBy("_k", "_x")
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1).join(starts.hint("shuffle_hash"), ["_g", "_b"])
    rank = (F.col("_r") + F.col("_start")).cast("long")
    out = ranked.withColumns({"_rank": rank, "block": F.floor(rank / F.lit(block)).cast("long")})
    if not sources:
        out = out.withColumns({"slot": F.lit(None).cast("long"), "position": F.col("_rank")})
    else:
        weight = _case(F.col("_g"), dict(enumerate(numbers)), 1)
        table = F.broadcast(_period_table(documents.sparkSession, slots, len(sources)))
        out = out.withColumn("_j", F.col("block") % weight).join(table, ["_g", "_j"], "left")
        turn = F.floor(F.col("block") / weight).cast("long")
        out = out.withColumn("slot", turn * period + F.col("_t"))
        # rows before this slot: of each source its blocks in earlier slots, as far as it has rows
        ahead = F.lit(0).cast("long")
        for k, a in enumerate(numbers):
            ahead = ahead + F.least((turn * a + F.element_at("_before", k + 1)) * block, F.lit(totals.get(k, 0)).cast("long"))
        known = sum(totals.get(k, 0) for k in range(len(sources)))
        out = out.withColumn("position", F.when(F.col("slot").isNotNull(), ahead + F.col("_rank") % block).otherwise(F.col("_rank") + known))
    return out.select(*columns, "block", "slot", "position")


def mixed(documents: DataFrame, weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    """The documents, all their columns, in the mixed order: partitions follow each other, rows in order inside."""
    read = {c: c if c in ("doc_id", "source", "text") else f"c{k}" for k, c in enumerate(documents.columns)}
    out = mix(documents.select(*[F.col(f"`{c}`").alias(x) for c, x in read.items()]), weights, block)
    return out.repartitionByRange("position").sortWithinPartitions("position").select(*[F.col(x).alias(c) for c, x in read.items()])


def with_position(written: DataFrame) -> DataFrame:
    """A table read from files, with position (from 0, without gaps): the order in which its rows were written.

    A reader deals files out in another order; the number in a file's name and the row's place in it tell the writer's.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = written.select("*", part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_part", "_file").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").withColumn("position", F.col("_start") + F.col("_at")).drop("_part", "_file", "_at", "_start")


def mix_sql(weights: dict[str, float], block: int = BLOCK) -> str:
    """The same report (doc_id, source, block, slot, position) as plain SQL over `documents`."""
    parts = whole_weights(weights)
    sources = list(parts)
    slots = schedule(list(parts.values()))
    values = ", ".join(f"('{sources[i]}', {parts[sources[i]]}, {sum(j == i for j in slots[:t])}, {t})" for t, i in enumerate(slots))
    return f"""
        WITH sched(source, weight, nth, place) AS (VALUES {values}),
        ranked AS (SELECT d.doc_id, d.source, w.source IS NOT NULL AS known,
                row_number() OVER (PARTITION BY CASE WHEN w.source IS NULL THEN '' ELSE 's' || d.source END ORDER BY md5(coalesce(d.doc_id::VARCHAR, ':' || coalesce(d.text, '')))) - 1 AS r
            FROM documents d LEFT JOIN (SELECT DISTINCT source FROM sched) w ON d.source = w.source),
        slotted AS (SELECT k.doc_id, k.source, k.known, k.r, k.r // {block} AS block, ((k.r // {block}) // s.weight) * {len(slots)} + s.place AS slot
            FROM ranked k LEFT JOIN sched s ON k.known AND k.source = s.source AND s.nth = (k.r // {block}) % s.weight)
        SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot,
            (row_number() OVER (ORDER BY slot NULLS LAST, r) - 1)::BIGINT AS position
        FROM slotted"""
