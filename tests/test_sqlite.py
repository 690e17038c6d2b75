"""SQLite files written and read back, filters and ranges included."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from labelspark.sources.sqlite import read_sqlite, write_sqlite


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_round_trip(spark, tmp_path):
    rows = [(1, "a", 0.5, b"x"), (2, None, None, None), (None, "çã \"'", float(10**300), b"\x00"), (2, None, None, None), (-(2**63), "", -0.25, b"")]
    df = spark.createDataFrame(rows, 'id long, `a "b` string, x double, raw binary')
    write_sqlite(df.repartition(3), str(tmp_path), "t")
    back = read_sqlite(spark, str(tmp_path), "t", rows=2)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert same(back, df)
    write_sqlite(df, str(tmp_path), "t")
    assert read_sqlite(spark, str(tmp_path), "t").count() == 10
    write_sqlite(df.limit(0), str(tmp_path), "t", "overwrite")
    assert read_sqlite(spark, str(tmp_path), "t").count() == 0


def test_filters_reach_the_files(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("x"))
    write_sqlite(df.repartition(2), str(tmp_path), "t")
    back = read_sqlite(spark, str(tmp_path), "t", rows=100)
    for condition in ("id >= 990", "id = 5 and s = 'n5'", "s in ('n1', 'n2') and x < 10.0", "x is null", "not (s = 'n1')", "s > 'n4'", "x <=> null", "id = 3 or s = 'n0'"):
        assert same(back.filter(condition), df.filter(condition)), condition
    assert same(read_sqlite(spark, str(tmp_path), "t", ["s"]).distinct(), df.select("s").distinct())
    assert "filter" in plan(back.filter("id >= 990")).lower()


def test_values_of_other_types(spark, tmp_path):
    """A column takes any value in such a file; one that is not of its type is null, whatever the filter."""
    file = str(tmp_path / "a.db")
    with sqlite3.connect(file) as con:
        con.execute("CREATE TABLE t (n INTEGER, s VARCHAR(9), d DECIMAL, free)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, "a", 1, 1), ("one", 5, 2.5, "x"), (2.5, b"b", "z", None)])
    con.close()
    back = read_sqlite(spark, file, "t")
    assert back.schema.simpleString() == "struct<n:bigint,s:string,d:double,free:string>"
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(1, "a", 1.0, "1"), (None, "5", 2.5, "x"), (None, None, None, None)], key=str)
    assert [tuple(r) for r in back.filter("n > 0").collect()] == [(1, "a", 1.0, "1")]
    assert back.filter("n is null").count() == 2
    assert back.filter("free = '1'").count() == 1
    assert spark.read.format("sqlite").option("path", file).option("table", "t").schema("d string").load().filter("d > '10'").count() == 2


def test_row_numbers_with_gaps(spark, tmp_path):
    with sqlite3.connect(str(tmp_path / "a.db")) as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
        con.executemany("INSERT INTO t VALUES (?)", [(-(2**62),), (0,), (2**62,)])
    con.close()
    assert sorted(r.id for r in read_sqlite(spark, str(tmp_path), "t").repartition(1).collect()) == [-(2**62), 0, 2**62]


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="no SQLite file"):
        read_sqlite(spark, str(tmp_path), "t").count()
    with pytest.raises(ValueError):
        write_sqlite(spark.createDataFrame([([1],)], "a array<int>"), str(tmp_path), "t")
    with pytest.raises(Exception, match="mounted folder"):
        read_sqlite(spark, "hdfs://x/y", "t").count()
