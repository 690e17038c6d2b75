"""Concepts whose names equal, hold or lie inside a query, against a loop over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from labelspark.operators import matching

QUERIES = ["warfarin", "Warfarin ", "ácido fólico", "acid", "iron", "spironolactone forte", "aaaaa", "aaaaaaa", "x", "", None, "zzzzzz"]


def concepts():
    rng = random.Random(3)
    names = ["Warfarin", "warfarin sodium", "spironolactone", "iron", "x", "", None, "folico", "acido folico", "acid", "aaaaaa", "aaaa", "ironic", "spironolactone", "Ácido"]
    names += ["".join(rng.choice(["aaa", "warfarin", " ", "iron", "acido", "x"]) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    return [(k, f"C{k % 40}", n) for k, n in enumerate(names)]


def expected(fold, rows, least=5, cap=25):
    out = set()
    for q in {q for q in QUERIES if q is not None and fold(q)}:
        f = fold(q)
        same = [(True, pos, cui, s) for pos, cui, s in rows if s is not None and fold(s) == f]
        near = [(False, pos, cui, s) for pos, cui, s in rows if s is not None and len(f) >= least and len(fold(s)) >= least and (f in fold(s) or fold(s) in f)]
        out |= {(q, cui, s, exact, pos) for exact, pos, cui, s in sorted(same or near, key=lambda r: r[1:3])[:cap]}
    return out


@pytest.mark.parametrize("sent", [matching.SENT, 0])
def test_both_directions(spark, monkeypatch, sent):
    import unicodedata

    fold = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().split())
    monkeypatch.setattr(matching, "SENT", sent)
    rows = concepts()
    q = spark.createDataFrame([(x,) for x in QUERIES], "query string")
    found = matching.concept_candidates(q, spark.createDataFrame(rows, "pos int, cui string, str string"))
    got = [tuple(r) for r in found.select("query", "cui", "str", "exact", "pos").collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(fold, rows)


def test_one_reading_and_nothing_to_find(spark):
    c = spark.createDataFrame(concepts(), "pos int, cui string, str string")
    none = spark.createDataFrame([(None,), (" ",)], "query string")
    assert matching.concept_candidates(none, c).count() == 0
    assert matching.concept_candidates(none.withColumn("query", F.lit("iron")), c.limit(0)).count() == 0
