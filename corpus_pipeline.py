"""A training corpus out of raw documents: each stage calls one operator on all rows its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import bpe, line_dedup, mixing, quality, simhash
from labelspark.llm.common import materialize
from labelspark.llm.queries import RANKS, WEIGHTS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the first document that holds them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word Jaccard similarity 0.8 or more, the least doc_id stays."""
    return simhash.keep_one(docs, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the mixture's order."""
    return mixing.mixed(docs, WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its position in the mixture, as written, its ids' number and digest, and the digest of what they decode to."""
    return bpe.bpe_report(mixing.with_position(docs), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("position",))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Fingerprints, rule ensembles and BPE are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
