"""The pipeline's near-copy stage against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelspark.llm import near_copies, simhash

DOCS = "doc_id long, text string, source string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """(doc_id, text) that stay: all pairs, least doc_id and mark left out of it."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group[root(i)] = root(j)
    best = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            best[root(k)] = min(best.get(root(k), d), d)
    return sorted(best.values())


def documents():
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    edit = lambda w, k: [x if i % max(len(w) // k, 1) else f"e{rng.randrange(10**6)}" for i, x in enumerate(w, 1)] if k else w
    texts, passage = [], say(60)
    for _ in range(25):
        base = say(rng.choice([12, 60, 200, 600]))
        texts += [edit(base, rng.randrange(0, 9)) for _ in range(4)]
    hub = say(300)
    texts += [edit(hub, rng.randrange(0, 6)) for _ in range(60)]  # near copies of a base, not always of each other
    chain = say(240)
    for k in range(12):
        chain = chain[:-6] + say(6)
        texts.append(list(chain))
    texts += [passage + say(rng.randrange(3, 120)) for _ in range(60)]
    rows = [(3 * k, " ".join(t), "a") for k, t in enumerate(texts)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "one two", "a"), (1003, "One  two", "a"), (1004, "one two three", "a"), (None, " ".join(hub), "a"), (None, "alone here", "a")]
    rows += [rows[5], (rows[5][0], "another text of a doc_id that is there, with words of its own", "a")]
    rng.shuffle(rows)
    return rows


def test_stage_keeps_one_of_each_group(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.schema == df.schema
    assert sorted(r.doc_id for r in out.filter("doc_id is not null").collect()) == kept(rows)
    assert out.filter("doc_id is null").count() == 2


@pytest.mark.parametrize(("small", "group", "dense"), [(1, 1, 4), (6, 1024, 10**6), (1, 40, 1)])
def test_crowds(spark, monkeypatch, small, group, dense):
    """Large groups, here nearly all, lose no link, be it by differences or in one task: near copies of one text, some too far from it, some of those close to each other."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]

    def edited(words, k):
        out = list(words)
        for at in rng.sample(range(len(out)), k):
            what = rng.randrange(3)
            out[at] = [f"e{rng.randrange(10**6)}"] if what == 0 else [] if what == 1 else [out[at], f"i{rng.randrange(50)}"]
        return [w for x in out for w in ([x] if isinstance(x, str) else x)]

    texts = [base] + [edited(base, rng.randrange(0, 10)) for _ in range(90)]
    far = [edited(base, 8) for _ in range(6)]
    texts += far + [edited(x, rng.randrange(0, 5)) for x in far for _ in range(4)]
    texts += [base[:100] + [f"t{k}_{i}" for i in range(rng.randrange(0, 40))] for k in range(20)] + [base + base[:k] for k in range(5, 60, 5)]
    rows = [(k, " ".join(t), "a") for k, t in enumerate(texts)] + documents()
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).collect()) == kept(rows)


def test_crowds_of_common_shingles(spark, monkeypatch):
    """A sample that sees all and one that sees nothing give the same."""
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(near_copies, "SAMPLE", 0)
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).filter("doc_id is not null").collect()) == kept(rows)


def test_no_rows(spark):
    assert simhash.keep_one(spark.createDataFrame([], DOCS), least=0.8).count() == 0


def test_names_that_clash_and_texts_that_share_a_doc_id(spark):
    """All columns come through under any name; of two texts of a doc_id each is judged by its own group."""
    base = " ".join(f"w{k}" for k in range(80))
    texts = [(1, base), (2, base + " x"), (2, "a text of its own that is like no other one here"), (3, "a text of its own that is like no other one here"), (3, base)]
    rows = [(d, t, d, "m", 7, "n", "k") for d, t in texts] + [(4, "again and again", 4, "m", 7, "n", "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep long, mark string, _rows int, c1 string, keep string")
    for least in (None, 0.8):
        out = simhash.keep_one(df, least)
        assert out.schema == df.schema
        got = sorted(map(tuple, out.collect()))
        if least:
            assert got == sorted([rows[0], rows[2], rows[5]])
        assert all(r[2:] == (r[0], "m", 7, "n", "k") for r in got) and got.count(rows[5]) == 1


def test_copies_are_filed_once(spark, monkeypatch):
    """3 000 copies of one text and one near copy: under each key that the two share there are two rows, not thousands."""
    seen = []
    against = near_copies._against
    monkeypatch.setattr(near_copies, "_against", lambda members, *rest: seen.append(members.groupBy("key").count().agg({"count": "max", "key": "count"}).first()) or against(members, *rest))
    base = " ".join(f"w{k}" for k in range(200))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(base).alias("text"), F.lit("a").alias("source"))
    df = df.unionByName(spark.createDataFrame([(5000, base + " more", "a"), (5001, "a text of its own", "a")], DOCS))
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).collect()) == [0, 5001]
    assert seen[0][0] == 2 and 1 <= seen[0][1] <= 41


def test_screen():
    """Bits that two sets of the similarity asked for may differ in: more for lower similarity, and hardly a link lost."""
    rng = random.Random(3)
    for least in (0.5, 0.8):
        for _ in range(300):
            n, shared = 300, round(300 * 2 * least / (1 + least))
            common = [rng.getrandbits(64) for _ in range(shared)]
            a, b = (near_copies.simhash(np.unique(np.array(common + [rng.getrandbits(64) for _ in range(n - shared)], np.uint64))) for _ in range(2))
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= near_copies.screen(least)
    assert near_copies.screen(0.95) < near_copies.screen(0.8) < near_copies.screen(0.5) < 64


def test_sketches():
    """Hardly a link of any size is lost, and texts that share a passage are told apart."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    lost = apart = 0
    for _ in range(500):
        n = int(rng.integers(1, 700))
        shared = draw(-(-n * 8 // 9))
        a, b = (np.unique(np.r_[shared, draw(n - len(shared))]) for _ in range(2))
        lost += not near_copies.agree(near_copies.sketch(a), near_copies.sketch(b), 0.8)
        c, d = (np.unique(np.r_[shared[: n // 2], draw(n)]) for _ in range(2))
        apart += not near_copies.agree(near_copies.sketch(c), near_copies.sketch(d), 0.8)
    assert lost == 0 and apart > 450


def test_fingerprints_find_first_and_shuffles_go(spark, monkeypatch):
    """Near copies within three bits come from SimHash links; what materialize shuffled is not kept."""
    from labelspark.llm import common

    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[:399], f"x{k}"]), "s") for k in range(4)] + [(9, "other " * 3, "s")]
    df = spark.createDataFrame(rows, DOCS)
    asked = []
    real = simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda classes: asked.append(classes.count()) or real(classes))
    monkeypatch.setattr(near_copies, "_against", lambda members, others, least: members.limit(0).selectExpr("node AS u", "node AS v"))
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).collect()) == [0, 9]
    assert len(asked) == 1 and asked[0] >= 2
    made = common.materialize(df.groupBy("doc_id").count())
    assert made.count() == 5 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _crowd(rng):
    """A hub with near copies, which share one passage with 80 texts that have nothing else in common; among those 8 near copies of each other."""
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = say(30)
    texts = [passage + say(200) for _ in range(80)]
    texts += [texts[3][:k] + say(9) + texts[3][k + 9 :] for k in range(40, 200, 20)]
    texts += [passage[:20] + texts[9][:-30] + say(30) for _ in range(12)]
    rows = [(k, " ".join(x), "a") for k, x in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("group", "dense"), [(7, 4), (7, 0)])
def test_crowds_that_share_a_passage_are_not_compared_by_differences(spark, monkeypatch, group, dense):
    """Groups too large for a task are compared in pieces, and only members of passing pairs by differences to the lead: those that share a passage alone differ in all else, so their differences would be as large as the texts."""
    monkeypatch.setattr(near_copies, "SMALL", 1)
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "SAMPLE", 0)
    seen = []
    real = near_copies._by_difference
    monkeypatch.setattr(near_copies, "_by_difference", lambda grouped, *rest: seen.append(grouped.select("node").distinct().count()) or real(grouped, *rest))
    rows = _crowd(random.Random(5))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(df, least=0.8).collect()) == kept(rows)
    assert sum(seen) <= 22
