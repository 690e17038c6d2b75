"""Questions, records and labels with equal texts are compared once, not row by row."""

import time

from pyspark.sql import functions as F

from labelspark.operators import dedup, matching
from labelspark.plans import star_queries


def _questions(spark, n):
    return spark.range(n).selectExpr("id", "concat('Gene', id % 2) AS variant", "if(id % 4 < 2, array('red plate'), array('none')) AS queries")


def _records(spark, n):
    return spark.range(n).selectExpr("id AS pos", "'gene0' AS variant", "'GENE0' AS gene", "if(id % 10 = 0, 'Red Plate; x', 'blue ring') AS chemicals", "cast(id % 3 as string) AS level")


def test_questions_meet_lists_of_chemicals_and_not_records(spark):
    began = time.monotonic()
    asked, records = _questions(spark, 8000), _records(spark, 8000)
    assert matching.variant_matches(asked, records).count() == 2000 * 800
    assert {(r.pos, r.level) for r in matching.best_variant(asked, records).select("pos", "level").collect()} == {(0, "0")}
    assert matching.best_variant(asked, records).count() == 2000
    by_gene = asked.withColumnRenamed("variant", "gene")
    assert matching.with_variant_evidence(by_gene, records).count() == 2000
    once = matching.variant_matches(by_gene, records, "gene").groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("p")).collect()
    assert len(once) == 2000 and {tuple(r.p) for r in once} == {(0, 10, 20)}
    assert time.monotonic() - began < 90  # 16 million pairs of texts took minutes for each of them


def test_equal_labels_are_read_once(spark):
    began = time.monotonic()
    register = spark.range(40_000).selectExpr("id AS file", "'Acid 7 tablets' AS name", "if(id % 2 = 0, 'acid 3', NULL) AS atc_label")
    compounds = spark.range(500).selectExpr("concat('c', id) AS compound", "concat('Acid ', id) AS inn", "concat('acid-', id) AS pt")
    found = matching.select_compounds(register, compounds).groupBy("compound", "route").count().collect()
    assert {tuple(r) for r in found} == {("c3", "inn", 20_000), ("c7", "pt", 40_000)}
    assert time.monotonic() - began < 60  # 30 million tests of a name against a label took longer


def test_longest_version_has_one_answer(spark):
    rows = [(1, p, "ab"[k] * 3) for p in range(50) for k in range(2)]
    for n in (1, 7):
        df = spark.createDataFrame(rows[::-1], "k int, p int, t string").selectExpr("k + p AS k", "0 AS pos", "t").repartition(n, "t")
        assert {r.t for r in dedup.longest_version(df, ["k"], "t", "pos").collect()} == {"aaa"}


def test_longest_version_keeps_the_table_s_order_of_ties(spark, tmp_path):
    """Lines that order, length, line number and part leave tied: the one that comes first in the table, whichever text is less."""
    rows = [(k, 7, 1, float(p)) for k in range(20) for p in ((94180.86, 25536.4) if k % 2 else (25536.4, 94180.86))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.l_orderkey: r.l_extendedprice for r in star_queries.longest_version(spark, str(tmp_path)).collect()}
    assert found == {k: "94180.86" if k % 2 else "25536.40" for k in range(20)}
