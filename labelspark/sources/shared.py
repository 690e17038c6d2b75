"""The folder that driver and executors share, and tables written there so that later steps neither repeat their work nor depend on the executors that did it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; a batch of very long texts must still fit a worker.
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: texts have no upper length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session or its context names it; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="labelspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whether Spark deletes a query's shuffle files when the query ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back. The table goes when the driver ends, the shuffles that made it go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/labelspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize wrote for tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
