"""Sharding against its laws and a placement in plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from labelspark.llm import queries, sharding

SCHEMA = "doc_id long, text string, size int, shard string, k string"


def key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16), len((text or "").encode()) + 1


def expected(rows, shards):
    """Slots of (doc_id, text) rows, from whole lists: large keys first, then the line, each key where its middle lies."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[key(text)].append(doc_id)
    total, part = sum(z * len(v) for (_, z), v in groups.items()), sharding.LARGE * shards
    large = sorted(g for g, v in groups.items() if len(v) * g[1] * part >= total or len(v) * part >= len(rows))
    rest = sum(z * len(v) for (k, z), v in groups.items() if (k, z) not in large)
    places, held, loads = sharding.allot([(k, z, len(groups[k, z])) for k, z in large], rest, shards)
    where = {}
    for g, (froms, at, bases) in zip(large, places, strict=True):
        for rank in range(len(groups[g])):
            j = max(i for i, x in enumerate(froms) if x <= rank)
            where.setdefault(g, []).append((at[j], bases[j] + rank - froms[j]))
    ends, before, seen = sharding.borders(loads, rest), 0, list(held)
    for g in sorted(set(groups) - set(large)):
        size = g[1] * len(groups[g])
        s = sum(2 * before + size >= x for x in ends)
        where[g] = [(s, seen[s] + j) for j in range(len(groups[g]))]
        seen[s], before = seen[s] + len(groups[g]), before + size
    return sorted((g, *p) for g, v in where.items() for p in v)


def laws(rows, out, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def check(spark, rows, shards, parts=5):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    out = sharding.shard_documents(df, shards).collect()
    laws(rows, out, shards)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    got = sorted((*key(t), r.shard, r.slot) for r in out for t in texts[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32 and len(t.encode()) + 1 == r.size) if all(len(v) == 1 for v in texts.values()) else None
    if got is not None:
        assert got == [(*g, s, j) for g, s, j in expected(rows, shards)]
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(shards)]
    return out, sizes


def test_even_and_whole(spark):
    """Sizes near equal, and equal texts together unless there are more than a shard holds."""
    rng = random.Random(4)
    rows = [(k, f"{k} " + "word " * min(900, int(rng.paretovariate(1.1) * 5))) for k in range(6000)] + [(10_000 + k, f"copy {k % 40} " * 9) for k in range(1200)]
    out, sizes = check(spark, rows, 16)
    assert max(sizes) - min(sizes) <= sum(sizes) / 16 / 60
    homes = defaultdict(set)
    for r in out:
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in homes.values())


def test_hot_text_and_cells(spark, monkeypatch):
    """A text that holds a third of all rows, one without doc_id that holds another; cells of few rows."""
    monkeypatch.setattr(sharding, "CELL", 32)
    monkeypatch.setattr(sharding, "LARGE", 4)
    rng = random.Random(5)
    rows = [(k, "the hot text") for k in range(1000)] + [(None, "no id")] * 900 + [(5000 + k, f"{k} " * rng.randrange(1, 9)) for k in range(1500)] + [(9000, None), (9001, ""), (9000, None), (1, "the hot text")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    for shards in (1, 7, 16):
        out = sharding.shard_documents(df, shards).collect()
        laws(rows, out, shards)
        sizes = [sum(r.size for r in out if r.shard == s) for s in range(shards)]
        # each border may be off by half of the largest key that is not large
        assert max(sizes) - min(sizes) <= 2 * sum(sizes) / shards / 4 + 1
    check(spark, [r for r in rows if r[0] is not None and r[0] >= 5000], 16)


def test_giants_and_few_rows(spark):
    out, sizes = check(spark, [(1, "x" * 900_000), (2, "y" * 300), (3, "z" * 300), (4, "w" * 300), (5, "v" * 300)], 4)
    assert sorted(sizes) == [301, 301, 602, 900_001]
    assert check(spark, [(1, "a")], 16)[1] == [2] + [0] * 15
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.createDataFrame([], SCHEMA), 0)


def test_allot_and_borders():
    rng = random.Random(6)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        large = [(k, rng.choice([1, 3, 10, 500]), rng.randrange(1, 40)) for k in range(rng.randrange(8))]
        rest = rng.randrange(0, 3000)
        places, held, loads = sharding.allot(large, rest, shards)
        seen = [[] for _ in range(shards)]
        for (_, _, rows), (froms, at, bases) in zip(large, places, strict=True):
            assert froms == sorted(froms) and (not froms or froms[0] == 0)
            for j, (x, s, base) in enumerate(zip(froms, at, bases, strict=True)):
                seen[s] += range(base, base + (froms[j + 1] if j + 1 < len(froms) else rows) - x)
        assert [sorted(v) for v in seen] == [list(range(n)) for n in held] and sum(loads) == sum(z * n for _, z, n in large)
        ends = sharding.borders(loads, rest)
        assert ends == sorted(ends) and all(0 <= x <= 2 * rest for x in ends)
        filled = [load + Fraction(b - a, 2) for load, a, b in zip(loads, [0, *ends], [*ends, 2 * rest], strict=True)]
        assert sum(filled) == sum(loads) + rest
        if rest and (low := [f for f, load in zip(filled, loads, strict=True) if f > load + 1]):
            assert max(low) - min(low) <= 1 and all(load >= min(low) - 1 for f, load in zip(filled, loads, strict=True) if f <= load)


def test_written(spark, tmp_path):
    """All columns, whatever their names, in the order of the slots."""
    rows = [(k, f"text {k % 50} " * 3, k, f"s{k}", f"k{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, source string, `a.b` string")
    kept = sharding.shard_documents(df, 5, carry=True)
    assert kept.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "source", "a.b"]
    sharding.write_shards(df.drop("a.b"), str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r.source) for r in back.collect()) == sorted((r[0], r[1], r[3]) for r in rows)
    ordered = [r.slot for r in spark.read.parquet(str(tmp_path / "shards" / "shard=2")).withColumn("f", F.input_file_name()).collect()]
    assert sorted(ordered) == list(range(len(ordered)))


def test_native(spark):
    """No Python, Arrow or RDD in the plan."""
    plan = sharding.shard_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.QUERIES["op12_shards"](spark, sf).collect()
    laws(rows, out, 16)
    texts = dict(rows)
    assert sorted((*key(texts[r.doc_id]), r.shard, r.slot) for r in out) == [(*g, s, j) for g, s, j in expected(rows, 16)]
