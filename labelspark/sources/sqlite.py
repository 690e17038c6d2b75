"""Tables in SQLite files as a data source: folders of files, written one a task and read in ranges of row numbers, filters included.

A folder holds one table in any number of files that declare it alike, which
the executors must see under the same path (a mounted folder). Files are read without locks, so
nobody may write to them meanwhile.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Rows of a batch; row numbers of a task unless the option `rows` says otherwise; ranges of a file, whose row numbers may have wide gaps.
BATCH, ROWS, RANGES = 8192, 1_000_000, 10_000
# The affinity of a declared type, by the first of these words that it holds, and the Spark type it is read as.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def local(path: str) -> str:
    """The path of a mounted folder."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite files lie in a mounted folder, not in {path}")
    return unquote(parts.path) if parts.scheme else path


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(file)}?mode=ro&immutable=1", uri=True)


def _files(path: str) -> list[str]:
    """The file, or those of the folder whose names do not begin with a point or an underscore."""
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f[0] not in "._" and f.endswith((".sqlite", ".db")))


def _type(declared: str) -> str:
    return next((t for word, t in AFFINITY if word in declared.upper()), "double" if declared else "string")


def _stored(v):
    """A value as SQLite holds it: times as ISO text in UTC, decimals as text."""
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, (datetime.date, decimal.Decimal)):
        return str(v)
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


def _read_as(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values of one column; what is not of its type is null."""
    if pa.types.is_int64(kind):
        return pa.array([v if isinstance(v, int) else None for v in values], kind)
    if pa.types.is_float64(kind):
        return pa.array([float(v) if isinstance(v, (int, float)) else None for v in values], kind)
    if pa.types.is_string(kind):
        return pa.array([None if v is None or isinstance(v, bytes) else str(v) for v in values], kind)
    return pa.array([v if isinstance(v, bytes) else None for v in values], kind)


@dataclass
class Range(ds.InputPartition):
    file: str
    first: int
    last: int


@dataclass
class Written(ds.WriterCommitMessage):
    file: str | None


class SqliteReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int, declared: dict[str, str]):
        self.path, self.table, self.schema, self.rows, self.declared = path, table, schema, rows, declared
        self.where: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Comparisons with numbers and strings narrow what is read; Spark tests all filters again, so a value of another type than its column's is never wrongly kept."""
        # a column without a type, or read as another one, is compared by other rules there
        kinds = {f.name: f.dataType.simpleString() for f in self.schema if _type(self.declared.get(f.name, "")) == f.dataType.simpleString() and self.declared.get(f.name)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            fits = {"bigint": int, "double": (int, float), "string": str}.get(kinds.get(name))
            if fits and type(f) in _COMPARED and isinstance(f.value, fits) and f.value == f.value:
                self.where.append((f"{_name(name)} {_COMPARED[type(f)]} ?", (f.value,)))
            elif fits and isinstance(f, ds.In) and len(f.value) <= 500 and all(isinstance(v, fits) for v in f.value):
                self.where.append((f"{_name(name)} IN ({', '.join('?' * len(f.value))})", tuple(f.value)))
            yield f

    def partitions(self) -> list[Range]:
        ranges = []
        for file in _files(self.path):
            with closing(_open(file)) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            if low is not None:
                step = max(self.rows, (high - low) // RANGES + 1)
                ranges += [Range(file, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return ranges or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema])
        where = [("rowid BETWEEN ? AND ?", (part.first, part.last)), *self.where]
        statement = f"SELECT {', '.join(_name(n) for n in schema.names)} FROM {_name(self.table)} WHERE {' AND '.join(w for w, _ in where)}"
        with closing(_open(part.file)) as con:
            cursor = con.execute(statement, [v for _, values in where for v in values])
            while rows := cursor.fetchmany(BATCH):
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([_read_as(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class SqliteWriter(ds.DataSourceWriter):
    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = path, table, schema, overwrite

    def _create(self, con: sqlite3.Connection) -> None:
        stored = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        con.execute(f"CREATE TABLE {_name(self.table)} ({', '.join(f'{_name(f.name)} {stored.get(f.dataType.simpleString(), "TEXT")}' for f in self.schema)})")

    def write(self, rows: Iterator) -> Written:
        """The rows of one task in a file that counts only once the job commits."""
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f"_{uuid.uuid4().hex}.sqlite")
        put = f"INSERT INTO {_name(self.table)} VALUES ({', '.join('?' * len(self.schema))})"
        with closing(sqlite3.connect(file)) as con:
            self._create(con)
            con.executemany(put, (tuple(map(_stored, r)) for r in rows))
            empty = con.total_changes == 0
            con.commit()
        if empty:
            os.remove(file)
        return Written(None if empty else file)

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = _files(self.path) if self.overwrite else []
        new = [m.file for m in messages if m and m.file]
        if not new and (self.overwrite or not _files(self.path)):
            # a table without rows is a table all the same
            new = [os.path.join(self.path, f"_{uuid.uuid4().hex}.sqlite")]
            with closing(sqlite3.connect(new[0])) as con:
                self._create(con)
                con.commit()
        for file in new:
            os.rename(file, os.path.join(self.path, "part-" + os.path.basename(file)[1:]))
        for file in old:
            os.remove(file)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.file and os.path.exists(m.file):
                os.remove(m.file)


class SqliteSource(ds.DataSource):
    """Options: path (a file, or a folder of *.sqlite and *.db files), table, rows (row numbers of a task)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _declared(self) -> dict[str, str]:
        found = _files(local(self.options["path"]))
        if not found:
            raise ValueError(f"no SQLite file in {self.options['path']}")
        with closing(_open(found[0])) as con:
            columns = con.execute("SELECT name, type FROM pragma_table_info(?) ORDER BY cid", (self.options["table"],)).fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {found[0]}")
        return dict(columns)

    def schema(self) -> T.StructType:
        """The columns of the first file's table, by their declared types: whole numbers, doubles, strings or bytes."""
        kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}
        return T.StructType([T.StructField(n, kinds[_type(t)]) for n, t in self._declared().items()])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(local(self.options["path"]), self.options["table"], schema, int(self.options.get("rows", ROWS)), self._declared())

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(local(self.options["path"]), self.options["table"], schema, overwrite)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """The table of a file or folder; only the columns named are read. Filters on numbers and strings are tested in the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    source = spark.read.format("sqlite").option("path", path).option("table", table).option("rows", rows)
    if columns is None:
        return source.load()
    kinds = SqliteSource({"path": path, "table": table}).schema()
    return source.schema(T.StructType([kinds[c] for c in columns])).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """One file a task, seen once all tasks are done. Times become ISO text, decimals text; nested columns are refused."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    if nested:
        raise ValueError(f"nested columns: {nested}")
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode(mode).option("path", path).option("table", table).save()
