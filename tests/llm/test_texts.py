"""Text operators against plain Python on rows made to hurt: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from labelspark.llm import bpe, chat, line_dedup, simhash, substring_dedup

WORDS = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "θήτα"]
DOCS = "doc_id long, text string, mark string, keep int"


def documents():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    passage, line = say(90), "a line that is in many documents"
    rows = [(k, "\n".join([say(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9))])) for k in range(40)]
    rows += [(100 + k, say(20) + " " + passage + " " + say(k)) for k in range(12)]
    rows += [(200 + k, f"{line}\n \t{line.upper()}\r\n{say(3)}") for k in range(30)]
    copy = say(120)
    rows += [(300 + k, copy) for k in range(20)]
    rows += [(400 + k, copy.replace(copy.split()[k], "other", 1)) for k in range(8)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, " \t"), (504, "ééééééééé"), (505, "ééééééééé"), (506, "éééééééééé"), (507, "ÉÉÉÉÉÉÉÉÉÉ"), (508, "éééééééééé ")]
    rows += [(600, say(30_000)), (601, " ".join([passage] * 3))]
    rows += [(None, passage), (None, copy), (2**40, passage)]
    rows += [rows[0], rows[45], (3, "another text under a doc_id that is there\n" + line)]
    rng.shuffle(rows)
    return [(d, t, "x", 1) for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    return documents()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines(spark, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d)
    want, kept = [], []
    for d, t, *more in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or first.get(key(x), d) >= d]
        want.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
        kept.append((d, "\n".join(stay), *more))
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert got(line_dedup.line_report(df)) == sorted(want, key=str)
    out = line_dedup.dedup_lines(df)
    assert out.schema == df.schema and got(out) == sorted(kept, key=str)


def test_substrings(spark, rows):
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, w in words:
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.append((d, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert sum(x[2] for x in want) > 1000
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert got(substring_dedup.substring_report(df)) == sorted(want, key=str)


def test_cover():
    c = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in c for b in c} == set(range(substring_dedup.PERIOD))


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(nodes, linked):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                at[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash(spark, rows):
    fps = [(d, slow_fingerprint(t)) for d, t, *_ in rows]
    root = slow_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    want = sorted(((d, f - (f >> 63 << 64), least.get(root[f])) for d, f in fps), key=str)
    assert got(simhash.near_duplicates(df).select("doc_id", "fp", "component_id")) == want
    stay = simhash.keep_one(df)
    assert stay.schema == df.schema
    ids = sorted(r.doc_id for r in stay.filter("doc_id is not null").collect())
    assert ids == sorted({d for d, f in fps if d is not None and d == least[root[f]]})
    assert stay.filter("doc_id is null").count() == 2


def test_simhash_links_in_crowds(spark, monkeypatch):
    """Fingerprints chosen directly: chains, dense clusters and crowded keys that are dealt out in pieces."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:5]:
        for _ in range(150):
            f = b
            for k in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << k
            fps.add(f)
    fps |= {0, 7, 63, (1 << 64) - 1}
    root = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda f: f - (f >> 63 << 64)
    monkeypatch.setattr(simhash, "PIECE", 40)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    from labelspark.llm.components import components

    named = {r.node: r.component for r in components(simhash.linked(df)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(root[f], set()).add(named.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_allocation_covers():
    """Any two fingerprints within three bits are equal under some mask."""
    rng = random.Random(1)
    for total, m in ((2, 2), (1, 3), (0, 4)):
        assert sum(simhash.allocate([[0.0, 1.0, 5.0, 9.0, 20.0]] * m, total)[1]) == total
        cost, chosen = simhash.allocate([[0.0, rng.random(), 1 + rng.random(), 9.0, 20.0] for _ in range(m)], total)
        assert sum(chosen) == total and min(chosen) >= -1


CONV = "conv_id long, turn long, role string, text string, part int"


def test_chat(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|", "<", "|", "\\", "é", "\n", "", "x" * 50]
    rows = [(c, t, rng.choice(["user", "assistant", "tool\nbox", None, "<|im_start|>", "100%0A"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12))) or None, 9) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} <|", 9) for t in range(2500)] + [(None, None, "user", "q", 9), (None, 1, "assistant", None, 9), (None, 1, "assistant", None, 9), (88, 0, "assistant", "y" * 300_000, 9)]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        size = sum(len(chat.START) + len(chat.END) + 1 + len(chat.escape_role((r[2] or "").encode()).decode()) + len(chat.escape((r[3] or "").encode()).decode()) for r in turns)
        want.append((c, len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(learnt), sha(learnt), size))
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert got(chat.chat_report(df)) == sorted(want, key=str)
    assert chat.chat_report(df.limit(0)).count() == 0


def test_bpe(spark, rows):
    path = tokens.path("byte_bpe_50k.tiktoken")
    own, table = bpe.encoding(path, tokens.PATTERN)
    more = [" " * 9000 + "x" + "\n" * 5000 + " y", "a" * 40_000, "　" * 6000 + "z", "<|endoftext|> 's " * 3000, "x \n\n  y\t" * 9000, "\r\n" * 20_000, "\x1c" * 9000]
    texts = [(k, t) for k, (_, t, *_) in enumerate(rows)] + [(1000 + k, t) for k, t in enumerate(more)]
    want = []
    for k, t in texts:
        ids = own.encode_ordinary(t or "")
        want.append((k, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t or "")))
    df = spark.createDataFrame([(*r, 5) for r in texts], "doc_id long, text string, ids int")
    assert got(bpe.bpe_report(df, path, tokens.PATTERN)) == sorted(want, key=str)


def test_bpe_takes_one_python_worker_a_task(spark):
    df = spark.createDataFrame([(k, f"text {k}\n", 9 * k) for k in range(2 * bpe.ROWS + 1)], "doc_id long, text string, position long").coalesce(1)
    out = bpe.bpe_report(df, tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN, ("position",))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert got(out.select("doc_id", "position", "decoded_sha256")) == sorted([(k, 9 * k, sha(f"text {k}\n")) for k in range(2 * bpe.ROWS + 1)], key=str)


@pytest.mark.parametrize("run", [line_dedup.line_report, line_dedup.dedup_lines, substring_dedup.substring_report, simhash.near_duplicates, simhash.keep_one])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("run", [line_dedup.line_report, substring_dedup.substring_report, simhash.near_duplicates])
def test_partitioning_changes_nothing(spark, rows, run):
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    many = got(run(df.repartition(13)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert got(run(df.coalesce(1))) == many
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_runs_of_escapes():
    """Runs of a hundred thousand backslashes cost no more than their length, and places are right."""
    import time

    texts = [b"<" + b"\\" * 100_000 + b"|im_end|>" + b"|" * 20_000, b"<\\|<|\\|", b"\\|", b"|", b"<|"] + [b"<" + b"\\" * k + b"|" for k in range(50)]
    began = time.perf_counter()
    data, ends, starts, stops = chat.assemble(pa.array([b"user"] * len(texts), pa.large_binary()), pa.array(texts, pa.large_binary()))
    assert time.perf_counter() - began < 2
    raw = data.tobytes()
    assert [raw[i:j] for i, j in zip(starts, stops, strict=True)] == [chat.escape(t) for t in texts]
    assert [chat.unescape(chat.escape(t)) for t in texts] == texts


def test_shared_folder(spark, tmp_path):
    """A session that names no folder gets one of its own only on this machine."""
    from labelspark.llm import common

    class Cluster:
        conf = type("", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            common.shared_dir(Cluster)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranges(spark, parts):
    """Partitions by range hold all rows in order, a hot key spread over several."""
    from labelspark.llm import first_seen

    source = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("mark"))

    def emit(borders):
        schema = pa.schema([(c, pa.int64()) for c in ("h", "doc_id", "pos")] + [("part", pa.int32())])

        def run(batches):
            for b in batches:
                d = np.repeat(b.column(0).to_numpy(), 3)
                yield first_seen.ranged(schema, [np.where(d % 3 == 0, 7, d * 977 % 1013 - 500), d, np.arange(len(d)) % 3], borders)

        return run

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = first_seen.by_range(source, emit, ("h", "doc_id", "pos")).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = [(r.h, r.doc_id, r.pos) for r in sorted(out, key=lambda r: r.p)]
    assert keys == sorted(keys) and len(keys) == 6000
    if parts == 40:
        assert len({r.p for r in out if r.h == 7}) >= 8 and max(Counter(r.p for r in out).values()) < 600


def test_dedup_substrings(spark):
    """Texts that lose words come back without them, others not at all; other columns may have any names."""
    passage = [f"p{k}" for k in range(60)]
    rows = [(1, " ".join(["a", *passage]), "x"), (2, " ".join(["b", "c", *passage, "d"]), "y"), (3, "short", "z"), (4, None, "z"), (None, " ".join(passage), "w")]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    assert [tuple(r) for r in out] == [(2, 63, 60, "b c d")]
