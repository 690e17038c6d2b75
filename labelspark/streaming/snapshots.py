"""A keyed cache that streams and several writers update: snapshots of hashed buckets, each named by a manifest that appears whole or not at all.

A merge reads and rewrites only the buckets whose keys changed; the others
are named again. A snapshot counts once its manifest is renamed to the next
number, which fails where another writer was first: then the merge is done
again on that writer's snapshot, so no change is lost and no lock is held. The
manifest also tells the last batch of each stream, so a batch that is replayed
after a failure changes nothing.

The folder's file system must rename without overwriting, as HDFS does. On a
local file system that holds among the threads of one driver.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Buckets of a new cache. A merge rewrites whole buckets, so take more for a larger one.
BUCKETS = 64
_RENAME = threading.Lock()


class Outrun(Exception):
    """Another writer has made the snapshot that this one was to make."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the snapshots there are."""
    path, system = _files(spark, root)
    folder = path(f"{root}/manifests")
    if not system.exists(folder):
        return []
    names = (f.getPath().getName() for f in system.listStatus(folder))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    path, system = _files(spark, root)
    name = path(f"{root}/manifests/{version:012d}.json")
    size = system.getFileStatus(name).getLen()
    stream = system.open(name)
    try:
        return json.loads(bytes(stream.readNBytes(size)))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Write a manifest under a name of its own, then rename it to its number."""
    path, system = _files(spark, root)
    own = path(f"{root}/manifests/.{uuid.uuid4().hex}")
    out = system.create(own)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        with _RENAME:
            context.rename(own, path(f"{root}/manifests/{version:012d}.json"), plain)
    except Exception as e:
        system.delete(own, False)
        if "FileAlreadyExistsException" in str(e):
            raise Outrun(version) from None
        raise


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the last snapshot, or of an earlier one that is still there."""
    known = versions(spark, root)
    if not known:
        raise ValueError(f"no snapshot in {root}")
    return _rows(spark, root, manifest(spark, root, known[-1] if version is None else version))


def _rows(spark: SparkSession, root: str, content: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    folders = [f"{root}/data/{p}/_bucket={b}" for b, p in content["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _latest(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key, the one greatest by order (null least); a newer one wins a tie, then the one greatest by all columns that can be ordered."""
    rest = [c for c in columns if c not in key]
    comparable = [f"`{c}`" for c in rest if rows.schema[c].dataType.typeName() not in ("map", "variant")]
    rank = F.struct(*[F.col(f"`{c}`") for c in order], F.col("_new"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(comparable)])
    best = rows.groupBy(*[f"`{c}`" for c in key]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_row"))
    return best.select(*[F.col(f"`{c}`") if c in key else F.col(f"_row.`{c}`") for c in columns])


def merge(changes: DataFrame, root: str, key: list[str], order: list[str], batch: tuple[str, int] | None = None, buckets: int = BUCKETS, attempts: int = 20) -> int:
    """Make the snapshot in which each key has its latest row of the last snapshot and of changes; return its number.

    key and order name columns; the greatest order wins, null is least, and a
    row of changes wins a tie. Null is a key like any other. Equal rows count
    once. With batch (name, number) a number that is not above the last one
    merged under that name changes nothing. The first merge fixes schema, key
    and number of buckets; changes with other columns are refused.
    """
    spark = changes.sparkSession
    names = [f.name for f in changes.schema]
    if "_bucket" in names or "_new" in names or len({n.lower() for n in names}) < len(names):
        raise ValueError("columns _bucket and _new are the cache's own, and names must differ")
    if not set(key) | set(order) <= set(names) or not key:
        raise ValueError("key and order must be columns")
    for _ in range(attempts):
        known = versions(spark, root)
        last = manifest(spark, root, known[-1]) if known else {"schema": changes.schema.jsonValue(), "key": key, "of": buckets, "buckets": {}, "batches": {}}
        if batch and last["batches"].get(batch[0], -1) >= batch[1]:
            return known[-1]
        schema = StructType.fromJson(last["schema"])
        if last["key"] != key or {(f.name, f.dataType.json()) for f in schema} != {(f.name, f.dataType.json()) for f in changes.schema}:
            raise ValueError("the cache has other columns or another key")
        try:
            return _merge_on(spark, last, known[-1] + 1 if known else 0, changes.select(*[f"`{f.name}`" for f in schema]), root, order, batch)
        except Outrun:
            continue
    raise RuntimeError(f"{attempts} other writers were first")


def _merge_on(spark: SparkSession, last: dict, version: int, changes: DataFrame, root: str, order: list[str], batch: tuple[str, int] | None) -> int:
    key, columns, path = last["key"], changes.columns, f"{version:012d}-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(last["of"])).cast("int")
    touched = [r[0] for r in changes.select(bucket).distinct().collect()]  # at most the number of buckets
    if touched:
        old = _rows(spark, root, last, touched).select(*[f"`{c}`" for c in columns])
        every = old.withColumn("_new", F.lit(False)).unionByName(changes.withColumn("_new", F.lit(True)))
        # rows meet by key, so a full bucket is written by many tasks
        _latest(every, key, order, columns).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{root}/data/{path}")
    content = last | {"buckets": last["buckets"] | {str(b): path for b in touched}}
    if batch:
        content["batches"] = last["batches"] | {batch[0]: batch[1]}
    try:
        _publish(spark, root, version, content)
    except Outrun:
        folder, system = _files(spark, root)
        system.delete(folder(f"{root}/data/{path}"), True)
        raise
    return version


def merge_stream(spark: SparkSession, source: str, schema: StructType | str, root: str, checkpoint: str, key: list[str], order: list[str], name: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge the files that came to source since the last run; name is the stream's own, whatever its runs."""
    rows = spark.readStream.schema(schema).parquet(source)
    put = lambda changes, number: merge(changes, root, key, order, (name, number), buckets) and None
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(spark: SparkSession, root: str, keep: int) -> int:
    """Delete all but the last `keep` snapshots and the data that none of these names; return how many folders went.

    No merge may run meanwhile: data that is written and not yet named would go.
    """
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    path, system = _files(spark, root)
    known = versions(spark, root)
    for v in known[:-keep]:
        system.delete(path(f"{root}/manifests/{v:012d}.json"), False)
    named = {p for v in known[-keep:] for p in manifest(spark, root, v)["buckets"].values()}
    folder = path(f"{root}/data")
    gone = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName() not in named] if system.exists(folder) else []
    for f in gone:
        system.delete(f, True)
    return len(gone)
