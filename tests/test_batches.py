"""Texts have no upper length: what a registered query hands to Python at once is bounded in bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspark.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["text_blocks", "text_blocks_lose_nothing", "preflight_documents"])
def test_batches_are_bounded_in_bytes(spark, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    QUERIES[name](spark, "/root/testdata/sf0.001")
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 8 << 20
