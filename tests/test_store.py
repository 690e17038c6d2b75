"""The store's tables and questions are worked out on few bytes a row, in pieces that do not grow with the tables."""

import re

from labelspark.plans import api, store


def _tables(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "substancia": one([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, nome string"),
        "documento": one([(k, (1, 3, 2, 4, 9, None)[k % 6]) for k in range(60)], "id long, substancia_id long"),
        "guideline": one([(10, "PA1", "CPIC", "G"), (11, "PA1", "CPIC", "G"), (12, "PA1", "CPIC", None), (13, "PA1", "CPIC", None)], "id long, guideline_id string, fonte string, gene string"),
        "cobertura": one([(k, 10 + k % 4, "coberta") for k in range(60)] + [(k, 11 - k % 2, "coberta") for k in range(0, 60, 3)] + [(99, 10, "coberta"), (1, 99, "ausente")], "documento_id long, guideline_id long, estado string"),
    }


def test_coverage_counts_under_numbers_and_not_texts(spark):
    t = _tables(spark)
    names, kinds = {1: "a", 2: "b", 3: "a"}, {10: "G", 11: "G", 12: None, 13: None}
    docs, seen = {r.id: r.substancia_id for r in t["documento"].collect()}, {}
    for r in t["cobertura"].collect():
        if r.documento_id in docs and r.guideline_id in kinds:
            seen.setdefault((names.get(docs[r.documento_id]), kinds[r.guideline_id]), set()).add(r.documento_id)
    out = api.coverage(t)
    assert {(r.substancia, r.gene): r.rotulos for r in out.collect()} == {k: len(v) for k, v in seen.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^]]*(substancia|fonte)#\d+[^]]*documento_id#", plan)


def test_a_substance_reads_its_own_rows_only(spark):
    """The mentions of a few documents are filtered before they are grouped; many documents, or none, give the same rows."""
    t = store.star_store(spark, "/root/testdata/sf0.001")
    rows = lambda: sorted(map(tuple, api.substance(t, "Customer#000000007")[2].collect()))
    want = rows()
    out = api.substance(t, "Customer#000000007")[2]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("collect_set") :].split("Aggregate [")[1]
    assert want and "LeftSemi" in grouped
    api.FEW, few = 0, api.FEW
    try:
        assert rows() == want
    finally:
        api.FEW = few
    assert api.substance(t, "nobody")[2].collect() == []


def test_documents_are_named_before_entities_meet_them(spark):
    plan = store.complete_view(store.star_store(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "substancia_id" in line]
    assert len(joins) == 1 and plan.index("Join Inner, (documento_id") < plan.index(joins[0])
