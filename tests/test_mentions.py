"""Mentions of many names in one reading, against expressions that look at one name at a time."""

import random
import re

from pyspark.sql import functions as F

from labelspark.functions import entities as ent
from labelspark.operators import matching, mentions

NAMES = ["CYP2D6*1", "CYP2D6*10", "CYP2D6*2", "HLA-B*1502", "hla-b*57:01", "POR", "AR", "ADA", "UGT1A1", "TPMT", "aa", "", None, "c.521T>C", "a-a"]


def texts():
    rng = random.Random(9)
    out = [
        "CYP2D6*10, CYP2D6*17, CYP2D6*1, CYP2D6*100", "CYP2D6*2xN", "CYP2D6 *1 e UGT1A1", "HLA-B*1502 HLAB*1502 HLA B*1502 hla‑b*57:01.", "tomar por via oral", "o gene POR codifica uma enzima. " + "x " * 200 + "POR",
        "artrite (AR)", "polimorfismo do gene ADA. " + "x " * 200 + "ADA", None, "", "aa aa-aa aaa aa", "tpmt_TPMT TPMT", "c.521T>C", "a-a-a a-a", "POR gene_POR gene POR2",
    ]
    pieces = ["CYP2D6*1", "CYP2D6 * 2", "cyp2d6*10", " ", ", ", "POR", "gene", "é", "HLA B*1502", "aa", "-", "AR", "alelo", "x" * 90, "TPMT"]
    return out + ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(150)]


def test_all_names_at_once(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    names = spark.createDataFrame([(n,) for n in NAMES + NAMES], "name string")
    pairs = df.crossJoin(names.distinct().filter("name is not null"))
    n = F.when(F.upper("name").isin(*ent.AMBIGUOUS), ent.ambiguous_count("text", "name")).otherwise(ent.allele_count(F.col("name"), F.col("text")).cast("long"))
    want = sorted(map(tuple, pairs.select("id", "name", n.alias("n")).filter("n > 0").collect()))
    for sent in (mentions.SENT, 40):
        monkeypatch.setattr(mentions, "SENT", sent)
        got = mentions.mention_counts(df, "id", "text", names, "name").groupBy("id", "name").agg(F.sum("n").alias("n"))
        assert sorted(map(tuple, got.collect())) == want
    assert {r[1] for r in want} >= {"POR", "ADA", "CYP2D6*1", "HLA-B*1502"}
    assert mentions.mention_counts(df, "id", "text", names.limit(0), "name").collect() == []
    assert mentions.mention_counts(df.limit(0), "id", "text", names, "name").collect() == []


def test_lexicon_by_trie_and_by_runs(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "CYP2D6*4", "rs12", "é", "x-1"]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    rows = [(k % 90, rng.choice([" ", ", ", "\n"]).join(rng.choice([*words, "other"]) for _ in range(rng.randrange(25)))) for k in range(120)] + [(200, None), (201, "")]
    df, lexicon = spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame([(t, "k") for t in terms], "term string, kind string")
    want = {}
    for i, t in rows:
        own, reach = re.findall(r"(?:[^\W_]|[*:-])+", (t or "").lower()), 0
        for at in range(len(own)):
            ends = [at + len(x.split()) for x in terms if own[at : at + len(x.split())] == x.lower().split()]
            if ends and max(ends) > reach:
                reach = max(ends)
                term = next(x for x in terms if x.lower().split() == own[at:reach])
                want[i, term, "k"] = want.get((i, term, "k"), 0) + 1
    for sent in (mentions.SENT, 10):
        monkeypatch.setattr(mentions, "SENT", sent)
        got = matching.lexicon_hits(df, "id", "text", lexicon, "term", "kind")
        assert {(r.id, r.term, r.kind): r.n for r in got.collect()} == want
    monkeypatch.setattr(mentions, "SENT", 10**6)
    assert "generate" not in matching.lexicon_hits(df, "id", "text", lexicon, "term")._jdf.queryExecution().analyzed().toString().lower().split("mapinarrow")[1]
