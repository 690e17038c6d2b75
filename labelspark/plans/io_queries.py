"""Readers, writers and streams over a small tree of files that each query writes to the shared folder first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.plans.registry import query, read, rows, table
from labelspark.sources import readers, sinks
from labelspark.sources.shared import shared_dir
from labelspark.sources.sqlite import read_sqlite, write_sqlite
from labelspark.streaming import incremental, snapshots


def _tree(spark: SparkSession, files: dict[str, bytes] | None = None) -> str:
    """A new folder that driver and executors share, with these files; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/labelspark-files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    system.deleteOnExit(path(folder))
    for name, data in (files or {}).items():
        out = system.create(path(f"{folder}/{name}"))
        out.write(bytearray(data))
        out.close()
    return folder


@query(table("file, size", [("a.pdf", 4), ("b.pdf", 6)]))
def pdf_files(spark, sf_dir):
    return readers.pdf_files(spark, _tree(spark, {"a.pdf": b"%PDF", "._a.pdf": b"x", "x/b.pdf": b"%PDF-1", "c.txt": b"y"})).select("file", F.col("size").cast("int").alias("size"))


@query(table("file", [("b.pdf",)]))
def listed_pdf_files(spark, sf_dir):
    d = _tree(spark, {"in/a.pdf": b"%PDF", "in/x/b.pdf": b"%PDF", "list.txt": b"b.pdf\n\n# a.pdf\nmissing.pdf\n"})
    return readers.pdf_files(spark, d + "/in", readers.file_list(spark, d + "/list.txt")).select("file")


@query(table("file, text", [("a.md", "| a\r |\r\n4.2 x\n"), ("b.md", " ")]))
def markdown_files(spark, sf_dir):
    return readers.whole_texts(spark, _tree(spark, {"a.md": b"| a\r |\r\n4.2 x\n", "x/b.md": b" ", "empty.md": b"", "c.txt": b"z"})).select("file", "text")


@query(table("doc, numero, genes", [("d1", "4.2", 2), ("d2", "4.4", 0)]))
def section_files(spark, sf_dir):
    part = lambda n, genes: json.dumps({"numero": n, "titulo": "t", "content": "x", "avaliacao_farmacogenomica": {"contem_farmacogenomica": "Sim", "pgx_entidades": {"genes": genes}}}).encode()
    tree = {"d1/s.json": part("4.2", ["TPMT", {"symbol": "DPYD"}]), "d1/ATC.json": part("4.3", []), "d1/bad.json": b"{broken", "d1/none.json": b'{"numero": "4.5"}', "d2/s.json": part("4.4", []), "d2/list.json": b"[1]"}
    return readers.section_files(spark, _tree(spark, tree)).select("doc", "numero", F.size("avaliacao_farmacogenomica.pgx_entidades.genes").alias("genes"))


@query(table("guideline_id, source, chemicals", [("PA1", "CPIC", ["warfarin"]), ("PA2", "CPIC", ["warfarin"]), ("PA3", "CPIC", [])]))
def guideline_files(spark, sf_dir):
    block = {"id": "PA1", "name": "n", "source": "CPIC", "relatedChemicals": [{"id": "1", "name": "warfarin"}], "relatedGenes": []}
    d = _tree(spark, {"a.json": json.dumps({"guideline": block}).encode(), "b.json": json.dumps([block | {"id": "PA2"}, {"guideline": block | {"id": "PA3", "relatedChemicals": []}}]).encode()})
    return readers.guidelines(spark, d).select("guideline_id", "source", "chemicals")


@query(table("med_id, rcm_filename", [("10020", "f.pdf"), ("7", None)]))
def register_file(spark, sf_dir):
    head = readers.REGISTER.replace(" string", "").replace(" ", "")
    return readers.register(spark, _tree(spark, {"r.csv": f"{head}\n10020,F,x,N02BE01;A,l,m,p,f.pdf,1,1\n7,G,y,,,,,,0,0\n".encode()}) + "/r.csv").select("med_id", "rcm_filename")


@query(table("compound, inn", [("varfarina", "warfarin"), ("x", "y"), ("z", "z")]))
def compound_lists(spark, sf_dir):
    return readers.compound_list(spark, _tree(spark, {"l.txt": b"1. varfarina;warfarin\n# no\n\n2) x\ty\nz\n"}) + "/l.txt").select("compound", "inn")


@query(table("symbol, name", [("DPYD", "second file, last row"), ("TPMT", "first file, last row")]))
def dictionary_order(spark, sf_dir):
    """The last row of a symbol wins in the order of files and rows, however unequal the files are."""
    row = lambda s, n: f"{s}\t\t{n}\t\t\t\t\n"
    head, fill = row("Symbol", "Name"), "".join(row(f"G{k}", "x" * 50) for k in range(3000))
    tree = {"1.tsv": head + row("DPYD", "first file") + row("TPMT", "first file, first row") + row("TPMT", "first file, last row"), "2.tsv": head + row("DPYD", "second file, first row") + fill + row("DPYD", "second file, last row")}
    genes = readers.gene_dictionary(spark, _tree(spark, {k: v.encode() for k, v in tree.items()}))
    return readers.last_by_symbol(genes).filter(F.col("symbol").isin("TPMT", "DPYD")).select("symbol", "name")


@query(table("ficheiro, hash", [("a", "2"), ("b", "3")]))
def fingerprint_logs(spark, sf_dir):
    return readers.fingerprint_log(spark, _tree(spark, {"f.jsonl": b'{"ficheiro": "a", "hash": "1"}\nbad line\n{"ficheiro": "a", "hash": "2"}\n{"ficheiro": "b", "hash": "3"}\n'}) + "/f.jsonl").select("ficheiro", "hash")


@query("SELECT lang AS doc, source AS secao, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def sections_written(spark, sf_dir):
    """Sections written as one JSON folder each and read back."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), F.col("source").alias("numero"), F.lit("").alias("titulo"), F.col("text").alias("content"))
    path = _tree(spark)
    sinks.write_sections(d, path)
    back = spark.read.schema("content string, doc string, secao string").json(path)
    return back.groupBy("doc", F.regexp_replace("secao", "_$", "").alias("secao")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_written(spark, sf_dir):
    n, path = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), _tree(spark)
    sinks.write_csv(n, path)
    return spark.read.csv(path, header=True, schema=n.schema)


@query("SELECT page_id, regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS html FROM pages")
def sheet_written(spark, sf_dir):
    """A report sheet without control characters, read back; rows without key are skipped."""
    p, path = read(spark, sf_dir, "pages").select("page_id", "html"), _tree(spark)
    sinks.write_sheets({"Páginas": p.unionByName(p.limit(1).withColumn("page_id", F.lit(None).cast("long")))}, path)
    return readers.sheet(spark, f"{path}/Páginas", "page_id", "page_id long, html string")


@query(r"SELECT doc_id, length(text)::INT AS caracteres, sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+', ' ', 'g')))) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'data|gina|aprovado|[0-9][/-]'))")
def streamed_fingerprints(spark, sf_dir):
    """A stream of files in two runs: the second reads only what came since. Texts with volatile phrases are left to volatile_fingerprint."""
    d, path = read(spark, sf_dir, "documents").select("doc_id", "text"), _tree(spark)
    plain = d.filter(~F.lower("text").rlike("data|gina|aprovado|[0-9][/-]") | F.col("text").isNull())
    for k in range(2):
        plain.filter(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{path}/in")
        incremental.fingerprint_stream(spark, f"{path}/in", plain.schema, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("doc_id long, hash string, caracteres int").parquet(f"{path}/out").filter("doc_id is not null")


@query(table("id, first, n", [(1, 1, 3), (4, 4, 1)]))
def first_texts_streamed(spark, sf_dir):
    """The first document of each text over two runs of a stream; the state holds the texts seen."""
    path, schema = _tree(spark), "doc_id long, text string"
    texts: list[DataFrame] = [rows(spark, schema, [(1, "a b")]), rows(spark, schema, [(2, "A  B"), (3, "a b"), (4, "d")])]
    for df in texts:
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        incremental.first_texts_stream(spark, f"{path}/in", schema, f"{path}/out", f"{path}/state").awaitTermination()
    every = texts[0].unionByName(texts[1]).groupBy(F.lower(F.regexp_replace("text", r"\s+", " ")).alias("t")).agg(F.count("*").cast("int").alias("n"), F.min("doc_id").alias("least"))
    first = spark.read.schema("doc_id long, hash string").parquet(f"{path}/out")
    return first.join(every, F.col("doc_id") == F.col("least")).select(F.col("doc_id").cast("int").alias("id"), F.col("least").cast("int").alias("first"), "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY user_id")
def merged_snapshots(spark, sf_dir):
    """The last event of each user, kept by a stream that runs twice; its last batch comes again and changes nothing."""
    e, path = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), _tree(spark)
    key, order = ["user_id"], ["event_id"]
    for k in range(2):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == k).write.mode("append").parquet(f"{path}/in")
        snapshots.merge_stream(spark, f"{path}/in", e.schema, f"{path}/cache", f"{path}/state", key, order, "events", 16).awaitTermination()
    again = e.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    snapshots.merge(again, f"{path}/cache", key, order, ("events", 1))
    return snapshots.snapshot(spark, f"{path}/cache").join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_type <> 'error' OR user_id % 3 = 0 GROUP BY user_id")
def snapshots_of_writers(spark, sf_dir):
    """Two names write to one cache in turn; an earlier event that comes later does not replace a later one."""
    e, path = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), _tree(spark)
    parts = (("late", e.filter("event_type <> 'error'")), ("early", e.filter("event_type = 'error' and user_id % 3 = 0")))
    for name, rows_ in parts:
        snapshots.merge(rows_, path, ["user_id"], ["event_id"], (name, 0), 16)
    snapshots.expire(spark, path, 1)
    return snapshots.snapshot(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders")
def sqlite_written(spark, sf_dir):
    """Orders in SQLite files, one a task, and read back in ranges of row numbers."""
    o, path = read(spark, sf_dir, "orders"), _tree(spark)
    write_sqlite(o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), path, "orders")
    return read_sqlite(spark, path, "orders", rows=5000).withColumnRenamed("o_orderdate", "day")


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem WHERE l_quantity >= 30 AND l_linestatus = 'F' GROUP BY l_orderkey")
def sqlite_filtered(spark, sf_dir):
    """Line items in SQLite files, filtered there: only the rows and columns of the question come back."""
    l, path = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"), "l_linestatus", "l_extendedprice"), _tree(spark)
    write_sqlite(l, path, "lineitem")
    t = read_sqlite(spark, path, "lineitem", ["l_orderkey", "l_quantity", "l_linestatus"])
    return t.filter("l_quantity >= 30 and l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
