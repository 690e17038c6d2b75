"""How queries register themselves, and how rows given literally reach both engines."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from labelspark.sources.shared import bound_batches

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL equivalent if there is one; its Python workers get batches of bounded size."""

    def put(f):
        @functools.wraps(f)
        def bounded(spark, sf_dir):
            bound_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name or f.__name__] = bounded
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, v)) + "]"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def table(columns: str, values: list[tuple]) -> str:
    """The same rows as SQL: a SELECT over VALUES."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql_literal, r)) + ')' for r in values)}) AS t({columns})"
