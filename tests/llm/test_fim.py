"""Fill-in-middle against slices of a list of lines."""

import hashlib
import random
import re

import duckdb
import pytest

from labelspark.llm import fim, queries

WORDS = (b"<P>", b"<S>", b"<M>")


def plain(text, doc_id, seed="7", rate=100, suffix_first=50, sentinels=fim.SENTINELS):
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(x in text for x in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    x, y, z = sentinels
    return (n, "spm", len(p), len(m), f"{y}{s}{x}{p}{z}{m}") if h4 % 100 < suffix_first else (n, "psm", len(p), len(m), f"{x}{p}{y}{s}{z}{m}")


TEXTS = [
    None, "", "\n", "\n\n", "one", "one\n", "one\ntwo", "é漢\n🙂x\n\nlast", "<P>", "a<S>b\nc", "a\n<M", ">\n<P\n>", "<<P\n", "\r\nx y\x85z\n", "\x00\n\x00",
    "line of some words\n" * 40_000 + "end", "x" * 500_000, "<" * 2000 + "\n" * 2000, "z\n" * 3000 + "<M>",
]


def test_bits():
    rng = random.Random(5)
    for _ in range(300):
        bits = rng.getrandbits(rng.randrange(1, 400))
        places = [k for k in range(bits.bit_length()) if bits >> k & 1]
        assert [fim.nth_bit(bits, k) for k in range(len(places))] == places
        text = "".join(rng.choice("aé\n<PSM>漢") for _ in range(rng.randrange(40)))
        assert fim.holds(text.encode(), WORDS) == any(x in text for x in fim.SENTINELS)
        assert fim.line_starts(text.encode()).bit_count() == len(re.findall("[^\n]*\n|[^\n]+", text))


def test_transform(spark):
    rows = [(k, t, "x", 3) for k, t in enumerate(TEXTS * 6)] + [(None, "a\nb\nc\n", "x", 3), (None, None, None, 3), (3, "a\nb\nc\n", "x", 3), (3, "a\nb\nc\n", "x", 3), (-9, "a\nb\nc\n", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(5)
    out = fim.fill_in_middle(df).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(i, *plain(t or "", i)) for i, t, *_ in rows], key=str)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    back = fim.fill_in_middle(df).select("doc_id", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t, *_ in rows], key=str)
    assert fim.fim_report(df.limit(0)).collect() == []


def test_settings(spark):
    """Other sentinels, seeds and shares; sentinels that could not be told from what they part are refused."""
    words = ("\x02pre|", "\x03suf", "\x04$^")
    rows = [(k, f"a{k}\n" * (k % 7) + "tail") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(df, words, "s", 60, 20).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"), words)).collect()
    for r in got:
        assert tuple(r)[1:-1] == plain(rows[r.doc_id][1], r.doc_id, "s", 60, 20, words) and r.back == rows[r.doc_id][1]
    share = {f: sum(r.form == f for r in got) for f in ("plain", "psm", "spm")}
    assert 90 < share["plain"] < 150 and share["spm"] < share["psm"]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "<P>x", "<M>"), ("a", "ba", "c"), ("é", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, bad)


def test_query(spark):
    """The query on a given table against the plain way and its SQL."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()))
    want = []
    for i, t in texts.items():
        n, form, before, middle, out = plain(t or "", i)
        want.append((i, n, form, before, middle, digest(out), digest(t or "")))
    assert got == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(queries.ORACLES["op11_fill_in_middle"]).fetchall()) == got
