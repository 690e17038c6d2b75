"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.sources.shared import BATCH_BYTES, BATCH_ROWS, bound_batches, discard, materialize, shared_dir  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it comes in fewer pieces than there are cores: a single small file would otherwise keep one core busy and all others idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _text_and_mark(text: Column, full: bool = True) -> tuple[Column, Column]:
    own = F.coalesce(text.cast("string"), F.lit(""))
    return own, F.unhex(F.md5(own.cast("binary"))) if full else F.xxhash64(own).bitwiseAND(F.lit(0x7FFFFFFF))


def with_id(documents: DataFrame, *more, full: bool = False) -> DataFrame:
    """doc_id as long, the text as UTF-8 bytes (null: empty), and a mark of the text that tells apart rows that share a doc_id: 31 bits that fit beside a place, or a full digest of 128."""
    text, mark = _text_and_mark(F.col("text"), full)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), mark.alias("mark"), *more)
    return spread(rows)


def keep_rows(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents, all their columns, whose (doc_id, mark), with the full digest, is chosen, one row of each; rows without doc_id stay. chosen: (doc_id, mark, rows), rows of that kind."""
    names = {c: f"c{k}" for k, c in enumerate(documents.columns)}
    docs = documents.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    doc_id, (_, mark) = F.col(names["doc_id"]).cast("long"), _text_and_mark(F.col(names["text"]))
    keep = chosen.select(F.col("doc_id").alias("keep"), F.col("mark").alias("keep_mark"), F.col("rows").alias("keep_rows"))
    own = (doc_id == F.col("keep")) & (mark == F.col("keep_mark"))
    out = docs.join(keep.filter("keep_rows = 1").hint("shuffle_hash"), own, "left_semi").unionByName(docs.filter(doc_id.isNull()))
    several = keep.filter("keep_rows > 1")
    if not several.isEmpty():
        again = docs.join(several.hint("shuffle_hash"), own, "left_semi")
        first = Window.partitionBy(doc_id, mark).orderBy(F.xxhash64(names["text"]))
        out = out.unionByName(again.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth"))
    return out.select(*[F.col(x).alias(c) for c, x in names.items()])


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
