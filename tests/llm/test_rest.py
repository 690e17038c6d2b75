"""Mixing, URL filters, the quality classifier and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as tokens
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelspark.llm import bpe, mixing, quality, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 1], [10, 3, 3, 1, 1, 1], [7, 5, 2, 2, 1], [1] * 9 + [20]])
def test_schedule_is_fair(weights):
    """After any number of slots each source has had its share but for less than one block, and none starts early or ends late."""
    period = sum(weights)
    slots = mixing.schedule(weights) * 2
    had = Counter()
    for t, i in enumerate(slots):
        j = had[i] + 1
        assert (j - 1) * period // weights[i] <= t < -(-j * period // weights[i])
        had[i] += 1
        assert all(abs(had[k] - Fraction((t + 1) * w, period)) < 1 for k, w in enumerate(weights))


DOCS = "doc_id long, text string, source string, slot string, position int, _g int"


def mixture():
    rows = [(k, f"t{k}", "a", "x", 1, 2) for k in range(3000)] + [(10_000 + k, f"u{k}", "b", "x", 1, 2) for k in range(170)] + [(20_000 + k, f"v{k}", "c", "x", 1, 2) for k in range(40)]
    return rows + [(30_000 + k, None, None if k % 2 else "zz", "x", 1, 2) for k in range(20)] + [(None, "n", "a", "x", 1, 2), (None, "n", "a", "x", 1, 2), rows[0]]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    weights, block = {"a": 3, "b": 2, "c": 1, "unseen": 2}, 4
    df = spark.createDataFrame(mixture(), DOCS).repartition(6)
    out = sorted(map(tuple, mixing.mix(df.select("doc_id", "text", "source"), weights, block, carry=False).select("position", "doc_id", "source", "block", "slot").collect()))
    assert [r[0] for r in out] == list(range(len(mixture())))
    totals, had = Counter(r[2] for r in mixture()), Counter()
    for k, (_, _, source, b, slot) in enumerate(out, 1):
        if source not in weights:
            assert slot is None and k > len(mixture()) - 20
            continue
        had[source] += 1
        assert b == (had[source] - 1) // block
        if all(had[s] + block <= totals[s] for s in ("a", "b", "c")) and k % block == 0:
            # "unseen" leaves its slots to the others, which keep their proportions
            assert abs(had["a"] / 3 - had["b"] / 2) * 2 <= 2 * block and abs(had["a"] / 3 - had["c"]) <= 2 * block
    kept = mixing.mixed(df, weights, block)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(df.limit(0), weights).count() == 0 and mixing.mix(df, {}).filter("slot is not null").count() == 0


def test_mix_order_without_gaps(spark):
    """While all sources last, every prefix of whole slots is within one block of the weights."""
    weights, block = {"a": 5, "b": 3, "c": 2}, 2
    rows = [(k, "t", "abc"[min(k % 10 // 4, 2)]) for k in range(600)]
    out = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block).select("position", "source").collect()))
    had, totals = Counter(), Counter(r[2] for r in rows)
    for k, (_, source) in enumerate(out, 1):
        had[source] += 1
        if k % block == 0 and all(had[s] + block <= totals[s] for s in weights):
            assert all(abs(had[s] / block - k / block * w / 10) < 1 for s, w in weights.items())


URLS = "page_id long, url string, html string, host int"


def test_urls(spark):
    cases = [
        (1, None, "", "", None, "allow"), (2, "no scheme/porn", "", "", None, "block"), (3, "http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        (4, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), (5, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), (6, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        (7, "https://x.com/fr/porn", "x.com", "/fr/porn", "com/fr/", "allow"), (8, "https://com/de/", "com", "/de/", "com/de/", "block"), (9, "https://com?/de/", "com", "", None, "allow"), (10, "", "", "", None, "allow"),
        (11, "http://x.net/adult-sex", "x.net", "/adult-sex", None, "block"), (12, "http://x.net/adult/adult", "x.net", "/adult/adult", None, "allow"), (13, "http://middlesex.net/adulthood", "middlesex.net", "/adulthood", None, "allow"),
        (14, "http://x.net/%20porn", "x.net", "/%20porn", None, "block"), (15, "http://x.net/0porn", "x.net", "/0porn", None, "allow"), (16, "http://x.net:80/a://b", "x.net:80", "/a://b", None, "allow"), (17, "://", "", "", None, "allow"),
        (18, "http://org#x", "org", "", None, "allow"), (18, "http://org#x", "org", "", None, "allow"), (19, "http://É.org/é?x=XXX", "É.org", "/é", "org/", "allow"), (None, "a://x.net/XXX", "x.net", "/XXX", None, "block"),
    ]
    df = spark.createDataFrame([(i, u, "h", 3) for i, u, *_ in cases], URLS).repartition(3)
    out = url_filter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(i, *r) for i, _, *r in cases], key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, c[1]) for k, c in enumerate(cases)])
    found = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op8_url_filter']})").fetchall())
    assert found == [(k, *c[2:]) for k, c in enumerate(cases)]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_weighted_vocabulary(spark):
    """Some thousand weighted terms against a plain count of distinct terms between boundaries."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcxyz") for _ in range(rng.randrange(2, 6))) for _ in range(3000)})
    table = [(w.upper() if k % 7 == 0 else w, 0.25 * (1 + k % 5)) for k, w in enumerate(words)] + [(None, 1.0), (" ", 1.0), ("zz", None), (words[0], 0.1)]
    terms = url_filter.read_terms(spark.createDataFrame(table, "term string, weight double"))
    assert terms == {w: 0.25 * (1 + k % 5) for k, w in enumerate(words)}
    urls = ["http://h.test/" + rng.choice("-/._").join(rng.choice(words) + rng.choice(["", "", "q"]) for _ in range(rng.randrange(0, 4))) for _ in range(400)]
    out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), terms=terms).collect()
    for r in out:
        found = {t for t in re.split("[^a-z0-9]+", urls[r.page_id]) if t in terms} | {t for t in terms if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", urls[r.page_id])}
        assert r.verdict == ("block" if sum(terms[t] for t in found) >= 2 else "allow") and r.n_strict == 0 and r.n_soft == len(found)
    with pytest.raises(ValueError):
        url_filter.read_terms(spark.createDataFrame(table, "term string, weight double"), most=10)


def test_whole_weights():
    """Fractions keep their shares, large numbers are brought into the period, and what cannot be scheduled is refused."""
    assert mixing.whole_weights({"b": 0.3, "a": 0.7, "z": 0}) == {"a": 7, "b": 3}
    assert mixing.whole_weights({"a": 20, "b": 10}) == {"a": 2, "b": 1} and mixing.whole_weights({}) == {}
    assert mixing.whole_weights({"a": 1 / 3, "b": 2 / 3}) == {"a": 1, "b": 2}
    assert mixing.whole_weights({"a": 9999, "b": 1}) == {"a": 9999, "b": 1}
    assert mixing.whole_weights({"a": 0.5, "b": 0.49999, "c": 0.00001}) == {"a": 50_000, "b": 49_999, "c": 1}
    large = mixing.whole_weights({"a": 10**9, "b": 1, "c": 0.37})
    assert min(large.values()) >= 1 and sum(large.values()) <= mixing.longest_period(3) + 3 and large["a"] > 800_000
    odd = mixing.whole_weights({f"s{k}": 0.1 + k / 977 for k in range(50)})
    total, longest = sum(0.1 + k / 977 for k in range(50)), mixing.longest_period(50)
    # a period that fits gives these exactly
    assert sum(odd.values()) <= longest and all(abs(odd[f"s{k}"] / sum(odd.values()) - (0.1 + k / 977) / total) < 1e-9 for k in range(50))
    uneven = {f"s{k}": math.sqrt(k + 2) for k in range(50)}
    parts, total = mixing.whole_weights(uneven), sum(uneven.values())
    assert sum(parts.values()) == longest and all(abs(parts[s] / longest - w / total) < 1 / longest for s, w in uneven.items())
    for bad in ({"a": -1}, {"a": float("nan")}, {"a": float("inf")}, {f"s{k}": 1 for k in range(3000)}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


def test_shares_far_below_a_thousandth(spark):
    """Blocks of one row at 9999 to 1: every prefix within one block."""
    rows = [(k, "t", "b" if k % 1000 == 0 else "a") for k in range(30_000)]
    out = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 9999, "b": 1}, 1).select("position", "source").collect()))
    had = 0
    for k, (position, source) in enumerate(out[:29_000], 1):
        had += source == "b"
        assert position == k - 1 and abs(had - k / 10_000) < 1


def test_rows_without_doc_id_are_spread(spark, monkeypatch):
    """Ten thousand rows without doc_id do not meet in one bucket's window, and all come out."""
    seen = []
    number = mixing.F.row_number
    monkeypatch.setattr(mixing.F, "row_number", lambda: seen.append(1) or number())
    rows = [(None, f"text {k}", "a") for k in range(10_000)] + [(k, "t", "b") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = df.select(F.substring(mixing.order_key(F.col("doc_id"), F.col("text")), 1, 2).alias("k")).groupBy("k").count().agg(F.max("count"), F.count("*")).first()
    assert keys[0] < 120 and keys[1] == 256
    out = mixing.mix(df, {"a": 1, "b": 1}).collect()
    assert seen and sorted(r.position for r in out) == list(range(12_000)) and len({r.text for r in out}) == 10_001


def test_fractional_weights(spark):
    rows = [(k, "t", "ab"[k % 2]) for k in range(2000)]
    out = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 0.7, "b": 0.3}, 2).select("position", "source").collect()))
    assert abs(sum(s == "a" for _, s in out[:1000]) - 700) < 2


def labelled(spark):
    good = ["the quick brown fox jumps over the lazy dog. it was a fine day and all went well. " * (k % 5 + 1) for k in range(150)]
    bad = [("buy### now%%% cheap&&& " * (k % 9 + 3)) if k % 2 else ("home | about | contact | " * (k % 7 + 3)) for k in range(150)]
    rows = [(k, t, "x", 7.0) for k, t in enumerate(good)] + [(1000 + k, t, "x", 7.0) for k, t in enumerate(bad)]
    labels = [(k, 1) for k in range(150)] + [(1000 + k, 0) for k in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, pipes string, score double"), spark.createDataFrame(labels + [(5, None), (99_999, 1), (None, 0), (7, 1)], "doc_id long, quality int")


def test_quality(spark):
    docs, labels = labelled(spark)
    more = docs.unionByName(spark.createDataFrame([(None, "x", "x", 1.0), (2000, None, "x", 1.0), (2001, "", "x", 1.0), (2002, "a " * 300_000, "x", 1.0), (5, "again", "x", 1.0)], docs.schema))
    model = quality.fit(more, labels)
    out = quality.score(more, model).collect()
    assert len(out) == more.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # the compiled expression is the model
    stats, names = quality.with_statistics(more.select("text"), F.col("text"))
    assert np.allclose(sorted(model.scores(np.array([tuple(r) for r in stats.select(*names.values()).collect()]))), sorted(r.score for r in out))
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and 140 <= kept.count() <= 160


def test_statistics(spark):
    texts = ["", None, "One, two.  two|\n\nA1b2 (x)[y]!? é%é\n", " \t lead\x0btail \x85 ", "ÀB" * 5000 + " 7" * 4000, "\\+_^-&&~~"]
    out, names = quality.with_statistics(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "s_0 long, text string"), F.col("text"), "x")
    for r in out.collect():
        t = texts[r.s_0] or ""
        words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
        share = lambda a, b: a / b if b else 0.0
        count = lambda marks: sum(c in marks for c in t)
        want = [np.log1p(len(words)), share(len(t) - len(words), len(words)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(len(words), len(lines))]
        want += [share(count(m), len(words)) for m in ("|", "%#$&*@^~=<>{}[]_\\+", "!?")] + [share(count(m), len(t)) for m in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")] + [share(count(m), len(words)) for m in (".;:", ",")]
        assert np.allclose([r[names[k]] for k in quality.STATISTICS], want)


def test_keep_good_and_names_that_clash(spark):
    """Columns called like the statistics, and labelled doc_ids that very many rows share."""
    docs, labels = labelled(spark)
    odd = docs.select("doc_id", "text", F.concat(F.lit("v"), "doc_id").alias("_s0"), F.lit("y").alias("score_1"), F.lit("z").alias("a.b"), F.lit("w").alias("c1"), F.lit("q").alias("score"))
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema and 140 <= kept.count() <= 160
    assert all((r._s0, r.score_1, r["a.b"], r.c1, r.score) == (f"v{r.doc_id}", "y", "z", "w", "q") for r in kept.collect())
    many = docs.unionByName(spark.range(3000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"), F.lit("x").alias("pipes"), F.lit(1.0).alias("score")))
    seen = []
    fit_rules = quality.fit_rules
    quality.fit_rules = lambda x, y, names: seen.append(len(y)) or fit_rules(x, y, names)
    try:
        quality.fit(many, labels, sample=100)
    finally:
        quality.fit_rules = fit_rules
    assert seen == [100]


def test_quality_without_labels(spark):
    docs, labels = labelled(spark)
    assert {(r.score, r.predicted) for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {(0.5, 1)}
    one = quality.score(docs, quality.fit(docs, labels.filter("quality = 0"))).collect()
    assert {r.predicted for r in one} == {0}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_held_back_rows_and_labels_decide_nothing(spark):
    """Other labels on held-out rows leave the model as it is."""
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_pipeline(spark):
    """Each stage against what it should do to its own input, and the result against the texts that reach the end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.select("doc_id").subtract(seen[-1].select("doc_id")).isEmpty()
        seen.append(out)
    good, lines, near, mixed = seen[1:]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = docs.join(labels, "doc_id")
    kept = {r.doc_id for r in good.collect()}
    clean = [r.doc_id for r in truth.filter("quality = 1").collect()]
    assert np.mean([d in kept for d in clean]) > 0.98
    assert lines.count() == good.count() and mixed.count() == near.count() <= lines.count()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in near.collect())
    own, _ = bpe.encoding(tokens.path(queries.RANKS), tokens.PATTERN)
    want = {r.doc_id: len(own.encode_ordinary(r.text or "")) for r in mixed.collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want
