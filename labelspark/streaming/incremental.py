"""Restart where the last run stopped: anti-joins, file streams that run once, rule versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelspark.functions.text import fingerprint


def pending(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents without a final result."""
    return docs.join(done.select(key), key, "left_anti")


def fingerprint_stream(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Fingerprints of the files that came since the last run, appended to the sink; the checkpoint remembers what was read."""
    rows = spark.readStream.schema(schema).parquet(source).select(key, fingerprint(F.col(text)).alias("hash"), F.length(text).alias("caracteres"))
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_texts_stream(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """The first document of each fingerprint over all runs; the fingerprints seen are the stream's state."""
    rows = spark.readStream.schema(schema).parquet(source).select(key, fingerprint(F.col(text)).alias("hash")).dropDuplicates(["hash"])
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def refresh(cache: DataFrame, version: int, recompute) -> DataFrame:
    """The cache with `guidelines` computed anew, by recompute, for rows of another rules version only; all else stays."""
    stale = cache.filter(F.coalesce(F.col("rules_version"), F.lit(-1)) != version)
    fresh = cache.filter(F.coalesce(F.col("rules_version"), F.lit(-1)) == version)
    return fresh.unionByName(recompute(stale.drop("guidelines", "rules_version")).withColumn("rules_version", F.lit(version)).select(cache.columns))


def once_each(df: DataFrame, column: str, name: str, expression) -> DataFrame:
    """df with an expensive expression of one column, computed once for each distinct value."""
    values = df.select(column).distinct().withColumn(name, expression)
    return df.join(values, df[column].eqNullSafe(values[column]), "left").drop(values[column])


def staged(docs: DataFrame, stages: list[tuple[str, object]]) -> DataFrame:
    """Documents with the first status that a stage gives them: (name, condition) pairs, in order; a failure is a column, not an exception."""
    status = F.when(F.lit(False), "")
    for name, failed in stages:
        status = status.when(failed, name)
    return docs.withColumn("status", status.otherwise("ok"))
