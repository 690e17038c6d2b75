"""Writers: sections and results as JSON, report tables, dumps, text reports, plans of file moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.text import ascii_safe, strip_controls


def section_name(number: Column, title: Column) -> Column:
    return F.concat_ws("_", F.replace(number, F.lit("."), F.lit("_")), ascii_safe(title))


def write_sections(sections: DataFrame, path: str) -> None:
    """One folder for each document and section, JSON inside."""
    named = sections.withColumn("secao", section_name(F.col("numero"), F.col("titulo")))
    named.write.mode("overwrite").partitionBy("doc", "secao").json(path)


def results_json(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc, json): the unique result of each document, empty fields left out."""
    return docs.select("doc", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def clean_sheet(df: DataFrame) -> DataFrame:
    """df with no control characters in its strings."""
    return df.select(*[strip_controls(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each sheet; names are legal sheet names (not blank, no apostrophe at either end) and distinct."""
    bad = [n for n in sheets if not n.strip() or len(n) > 31 or any(c in n for c in "[]:*?/\\") or "'" in (n[0], n[-1])]
    if bad or len({n.lower() for n in sheets}) < len(sheets):
        raise ValueError(f"sheet names: {bad or 'not distinct'}")
    for name, df in sheets.items():
        clean_sheet(df).write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def duration(seconds: Column) -> Column:
    """1h 02m 03s."""
    s = F.floor(seconds)
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def batch_report(runs: DataFrame) -> DataFrame:
    """One row of totals over (doc, status, seconds)."""
    ok = F.col("status") == "ok"
    return runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("review"), duration(F.coalesce(F.sum("seconds"), F.lit(0))).alias("duration"), F.round(F.avg("seconds"), 1).alias("mean_s"))


def moves(files: DataFrame, target: Column, reason: Column) -> DataFrame:
    """(de, para, motivo): a plan of moves, without those that change nothing and those whose target two files want."""
    plan = files.select(F.col("path").alias("de"), target.alias("para"), reason.alias("motivo")).filter("de <> para")
    taken = plan.groupBy("para").agg(F.count("*").alias("_n")).filter("_n > 1")
    return plan.join(taken, "para", "left_anti").select("de", "para", "motivo")
