"""Readers of label texts, sections, dictionaries, registers and caches. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.operators.matching import first_by

SECTION = """numero string, titulo string, content string, codigo string,
    tabelas array<struct<numero:string,titulo:string,texto:string>>, figuras array<struct<numero:string,descricao:string>>,
    avaliacao_farmacogenomica struct<contem_farmacogenomica:string,informacao_farmacogenomica:string,texto_para_entidades:string,
        pgx_entidades:struct<genes:array<string>,star_alleles:array<string>,diplotypes:array<string>,rsids:array<string>>>, _bad string"""
# Files of a document's folder that are no sections.
NO_SECTION = ("ATC.json", "Substancia_ativa.json", "Nome_do_Medicamento.json", "Grupo_farmacoterapeutico.json", "NAO_UTILIZAVEL.json")
REGISTER = "med_id string, drug_name string, active_substance string, atc_codes string, atc_labels string, mah string, pharma_form string, rcm_filename string, has_rcm string, rcm_verified string"
GENES = "symbol string, alternates string, name string, pharmgkb_id string, ncbi_gene_id string, hgnc_id string, ensembl_id string"
VARIANTS = "variant string, gene string, type string, level string, chemicals string, phenotypes string"
FINGERPRINT = "ficheiro string, digitalizacao boolean, caracteres long, hash string, motivo string, erro string, word_density double, letter_fraction double, control_fraction double"


def with_pos(files: DataFrame) -> DataFrame:
    """Rows as read from files, with pos: a struct that sorts them by file name, by the piece of the file a task read, and by the place in it.

    It must stand right on the reader: what a projection has left knows no file.
    Ids grow with the place inside a piece; Spark deals pieces out by size.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return files.withColumn("pos", place)


def pdf_files(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """(path, file, size) of the PDFs below a folder but for resource forks; only those listed, if a list is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size")).filter(~F.col("file").startswith("._"))
    return files if listed is None else files.join(listed.select("file"), "file", "left_semi")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a list; blank lines and comments are no files."""
    rows = spark.read.text(path).select(F.trim("value").alias("file"))
    return rows.filter((F.col("file") != "") & ~F.col("file").startswith("#")).distinct()


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, file, text), line ends as they are. An empty file gives no row, so with_markdown falls back as for a missing one."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def with_markdown(docs: DataFrame, converted: DataFrame, extracted: DataFrame) -> DataFrame:
    """docs (doc) with the converted text, else the extracted one; null where there is neither."""
    a, b = converted.select("doc", F.col("text").alias("_a")), extracted.select("doc", F.col("text").alias("_b"))
    return docs.join(a, "doc", "left").join(b, "doc", "left").withColumn("text", F.coalesce("_a", "_b")).drop("_a", "_b")


def section_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, file, section fields) of the JSON objects below a folder that hold an evaluation; others are skipped."""
    rows = spark.read.schema(SECTION).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumns({"file": F.col("_metadata.file_name"), "doc": F.element_at(F.split("_metadata.file_path", "/"), -2)})
    return rows.filter(F.col("_bad").isNull() & F.col("avaliacao_farmacogenomica").isNotNull() & ~F.col("file").isin(*NO_SECTION)).drop("_bad")


def first_existing(paths: DataFrame, wanted: list[str]) -> DataFrame:
    """Of (doc, file, path) the one file of each document that comes first in a list of names."""
    rank = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("file"))
    return first_by(paths.withColumn("_r", rank).filter("_r > 0"), ["doc"], ["_r", "path"]).drop("_r")


def split_unusable(docs: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without and with a marker that they cannot be used."""
    m = markers.select("doc")
    return docs.join(m, "doc", "left_anti"), docs.join(m, "doc", "left_semi")


def gene_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return with_pos(spark.read.csv(path, sep="\t", header=True, schema=GENES)).filter(F.trim("symbol") != "")


def last_by_symbol(genes: DataFrame) -> DataFrame:
    """Of rows of one upper-case symbol the last."""
    return first_by(genes.withColumn("_k", F.upper(F.trim("symbol"))), ["_k"], [F.desc("pos")]).drop("_k")


def variant_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return with_pos(spark.read.csv(path, sep="\t", header=True, schema=VARIANTS))


def guidelines(spark: SparkSession, path: str) -> DataFrame:
    """(guideline_id, name, source, chemicals, genes, raw) of JSON files that hold one record or an array of them, the block under `guideline` or the record itself."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json(F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), "array<string>").alias("r"))
    rows = rows.select(F.explode("r").alias("raw")).withColumn("block", F.coalesce(F.get_json_object("raw", "$.guideline"), F.col("raw")))
    block = "id string, name string, source string, relatedChemicals array<struct<id:string,name:string>>, relatedGenes array<struct<id:string,symbol:string,name:string>>"
    b = rows.withColumn("b", F.from_json("block", block))
    return b.select(F.col("b.id").alias("guideline_id"), "b.name", "b.source", F.col("b.relatedChemicals.name").alias("chemicals"), F.concat(F.coalesce("b.relatedGenes.symbol", F.array().cast("array<string>")), F.coalesce("b.relatedGenes.name", F.array().cast("array<string>"))).alias("genes"), F.col("block").alias("raw"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cui, lat, scui, sdui, sab, code, str) of a pipe-separated concept file; short rows are skipped."""
    f = F.split("value", r"\|")
    rows = with_pos(spark.read.text(path)).select(f.alias("f"), "pos").filter(F.size("f") >= 15)
    names = {"cui": 0, "lat": 1, "scui": 9, "sdui": 10, "sab": 11, "code": 13, "str": 14}
    return rows.select(*[F.col("f")[k].alias(n) for n, k in names.items()], "pos")


def register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=REGISTER)


def latest(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last record of each key of an append-only log."""
    return first_by(rows.filter(F.col(key).isNotNull()), [key], [F.desc(pos)])


def fingerprint_log(spark: SparkSession, path: str) -> DataFrame:
    """The last fingerprint of each file of a JSON-Lines log; bad lines are skipped."""
    rows = spark.read.schema(FINGERPRINT + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return latest(with_pos(rows).filter("_bad is null").drop("_bad"), "ficheiro", "pos").drop("pos")


def compound_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, compound, inn) of lines `12. name;inn`, separated by tab, semicolon or bar."""
    parts = F.transform(F.split(F.regexp_replace("value", r"^\s*\d+[.)]\s*", ""), r"[\t;|]"), lambda x: F.trim(x))
    rows = with_pos(spark.read.text(path)).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select("pos", parts[0].alias("compound"), F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]).alias("inn"))


def sheet(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A report table written by sinks.sheets; rows without key are skipped."""
    return spark.read.schema(schema).parquet(path).filter(F.col(key).isNotNull())


def mesh_id(summary: DataFrame) -> DataFrame:
    """(query, mesh_id) of lookup answers (query, json): from the known key, else the first id anywhere in the answer."""
    shape = r"\b(D\d{6})\b"
    known = F.regexp_extract(F.coalesce(F.get_json_object("json", "$.ds_meshui"), F.lit("")), shape, 1)
    return summary.select("query", F.coalesce(F.nullif(known, F.lit("")), F.nullif(F.regexp_extract("json", shape, 1), F.lit(""))).alias("mesh_id"))
