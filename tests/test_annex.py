"""Where annex I ends and which medicines its summaries name; lots of rows without a value."""

from pyspark.sql import functions as F

from labelspark.functions import sections
from labelspark.operators import dedup

HEAD = "1. NOME DO MEDICAMENTO"


def outline(spark, *pages):
    rows = spark.createDataFrame([("a", k, t) for k, t in enumerate(pages, 1)], "doc string, page int, text string")
    return sections.annex_outline(rows).first()


def test_two_summaries_in_a_whole_annex(spark):
    r = outline(spark, f"x\n {HEAD}\n\n Tivi  50 mg\n2.  COMPOSIÇÃO", "ver Anexo II", f"1.  nome do medicamento\n{'n' * 300}", "a\n  ANEXO II\nb", f"{HEAD}\nlabel", "o Folheto informativo")
    assert (r.pages, r.annex_page, r.whole_annex, r.last_page, r.n_summaries, r.first_summary_end) == (6, 4, True, 3, 2, 2)
    assert (r.first_name, r.second_name) == ("Tivi 50 mg", "n" * 70)


def test_bare_summary(spark):
    r = outline(spark, f"RESUMO DAS CARACTERÍSTICAS\n{HEAD}", None, "ver ANEXO II e folheto informativo", "")
    assert (r.annex_page, r.whole_annex, r.last_page, r.n_summaries, r.first_summary_end, r.first_name, r.second_name, r.n_titles) == (None, False, 4, 1, 4, "", "", 1)
    r = outline(spark, "nada")
    assert (r.n_summaries, r.first_name, r.last_page) == (0, "", 1)


def test_rows_without_a_value_share_no_task(spark):
    """Lots keep their size where most rows have no value, and these come first."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    out = dedup.lots(df, 8, "v", slices=4)
    assert sorted(r["count"] for r in out.groupBy("lot").count().collect()) == [250] * 8
    assert out.filter("v IS NULL").agg(F.max("lot")).first()[0] <= out.filter("v IS NOT NULL").agg(F.min("lot")).first()[0]
    assert sorted(r.id for r in out.collect()) == list(range(2000))
