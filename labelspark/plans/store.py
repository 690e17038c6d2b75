"""The relational store: seven tables and a view, loaded so that the first row of a key wins, verified, and dumped as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.operators.matching import first_by
from labelspark.plans.statements import numbered

#: Tables in the order in which their references resolve.
TABLES = ("substancia", "documento", "entidade", "entidade_seccao", "passagem", "guideline", "cobertura")
#: Natural keys.
KEYS = {
    "substancia": ["nome"], "documento": ["ficheiro"], "entidade": ["documento_id", "tipo", "valor"], "entidade_seccao": ["entidade_id", "seccao"],
    "passagem": ["documento_id", "seccao"], "guideline": ["guideline_id", "farmaco", "gene"], "cobertura": ["documento_id", "guideline_id"],
}

#: Documents whose rows a task gathers, about.
DOCUMENTS = 100_000


def first_wins(rows: DataFrame, table: str, order: list) -> DataFrame:
    """rows without those whose natural key an earlier one has."""
    return first_by(rows, KEYS[table], order)


def load(substances: DataFrame, documents: DataFrame, mentions: DataFrame, passages: DataFrame, coverage: DataFrame) -> dict[str, DataFrame]:
    """The seven tables out of rows by document.

    substances (nome, cui, drugbank, mesh, aliases, pos); documents (ficheiro, medicamento, nome, ..., pos);
    mentions (ficheiro, tipo, valor, gene, seccao, mencoes); passages (ficheiro, seccao, texto, pos);
    coverage (ficheiro, guideline_id, fonte, farmaco, gene, estado, genes_em_falta).
    A mention without section counts in the entity's total and gets no section row.
    """
    low = F.lower(F.trim("nome"))
    t = {"substancia": numbered(first_wins(substances.withColumn("nome", low), "substancia", ["pos"]).drop("pos"), ["nome"])}
    ids = t["substancia"].select("nome", F.col("id").alias("substancia_id"))
    t["documento"] = numbered(first_wins(documents.withColumn("nome", low), "documento", ["pos"]).drop("pos").join(ids, "nome", "left").drop("nome"), ["ficheiro"])
    docs = t["documento"].select("ficheiro", F.col("id").alias("documento_id"))
    m = mentions.join(docs, "ficheiro")
    total = m.groupBy("documento_id", "tipo", "valor").agg(F.min("gene").alias("gene"), F.sum("mencoes").cast("long").alias("mencoes"))
    t["entidade"] = numbered(total, ["documento_id", "tipo", "valor"])
    e = t["entidade"].select("documento_id", "tipo", "valor", F.col("id").alias("entidade_id"))
    t["entidade_seccao"] = m.filter("seccao is not null").join(e, ["documento_id", "tipo", "valor"]).groupBy("entidade_id", "seccao").agg(F.sum("mencoes").cast("long").alias("mencoes"))
    t["passagem"] = numbered(first_wins(passages.join(docs, "ficheiro").drop("ficheiro"), "passagem", ["pos"]).drop("pos"), ["documento_id", "seccao"])
    t["guideline"] = numbered(coverage.groupBy("guideline_id", "farmaco", "gene").agg(F.min("fonte").alias("fonte")), ["guideline_id", "farmaco", "gene"])
    g = t["guideline"].select("guideline_id", "farmaco", "gene", F.col("id").alias("_g"))
    c = coverage.join(docs, "ficheiro").join(g, ["guideline_id", "farmaco", "gene"]).select("documento_id", F.col("_g").alias("guideline_id"), "estado", "genes_em_falta")
    t["cobertura"] = first_wins(c, "cobertura", ["estado"])
    return t


def coverage_rows(details: DataFrame) -> DataFrame:
    """One row for each expected gene of (ficheiro, guideline_id, fonte, farmaco, expected array, mentioned array): covered or absent."""
    seen = F.array_contains("mentioned", F.col("gene"))
    return details.withColumn("gene", F.explode("expected")).select("ficheiro", "guideline_id", "fonte", "farmaco", "gene", F.when(seen, "coberta").otherwise("ausente").alias("estado"), F.when(~seen, F.col("gene")).alias("genes_em_falta"))


def complete_view(t: dict[str, DataFrame]) -> DataFrame:
    """One row for each entity with its document and substance, its sections in one cell."""
    sections = t["entidade_seccao"].groupBy(F.col("entidade_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("seccao")), " ; ").alias("seccoes"))
    d = t["documento"].select(F.col("id").alias("documento_id"), "ficheiro", "medicamento", "codigo_atc", "grupo_codigo", "substancia_id")
    s = t["substancia"].select(F.col("id").alias("substancia_id"), F.col("nome").alias("substancia"), "cui", "drugbank")
    named = d.join(s, "substancia_id", "left").drop("substancia_id")  # before the entities, which are more than the documents and would be shuffled by substance as well
    out = t["entidade"].join(sections, "id", "left").join(named, "documento_id")
    return out.select("id", "tipo", "valor", "gene", "seccoes", "mencoes", "ficheiro", "medicamento", "codigo_atc", "grupo_codigo", "substancia", "cui", "drugbank")


def dealt(rows: DataFrame, documents: int, *keys: str) -> DataFrame:
    """rows, of so many documents, dealt out by keys; the more documents there are, the more pieces, so that what a task gathers does not grow with them."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-documents // DOCUMENTS)), *keys)


def table_counts(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in t.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tabela"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("vazia", F.col("n") == 0)


def inconsistent_totals(t: dict[str, DataFrame]) -> DataFrame:
    """Entities whose sections add up to more than their total."""
    s = t["entidade_seccao"].groupBy(F.col("entidade_id").alias("id")).agg(F.sum("mencoes").alias("por_seccao"))
    return t["entidade"].join(s, "id").filter("por_seccao > mencoes").select("id", "mencoes", "por_seccao")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def star_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same seven tables over the star schema: customers as substances, orders as documents, line items as mentions, brands as genes, suppliers' nations as sources."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    l, p, s = read("lineitem"), read("part"), read("supplier")
    kind = F.when(F.col("l_returnflag") == "A", "gene").when(F.col("l_returnflag") == "N", "alelo").otherwise("diplotipo")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("documento_id"), kind.alias("tipo"), F.col("p_name").alias("valor"), F.col("p_brand").alias("gene"), F.col("l_linestatus").alias("seccao"), F.col("l_quantity").cast("long").alias("n"), "l_suppkey"
    )
    entity = ["documento_id", "tipo", "valor"]
    key = F.concat_ws("|", *entity)
    guides = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("PA"), F.col("s_nationkey")).alias("guideline_id"), F.when(F.col("s_nationkey") % 2 == 0, "CPIC").otherwise("DPWG").alias("fonte"), F.col("s_name").alias("farmaco"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("gene"))
    o = read("orders")
    asked = rows.join(guides.select(F.col("id").alias("l_suppkey"), F.col("gene").alias("wanted")), "l_suppkey").select("documento_id", F.col("l_suppkey").alias("guideline_id"), (F.col("gene") == F.col("wanted")).alias("y"))
    cover = dealt(asked, o.count(), "documento_id").groupBy("documento_id", "guideline_id").agg(F.bool_or("y").alias("y")).join(guides.groupBy(F.col("id").alias("guideline_id")).agg(F.min("gene").alias("w")), "guideline_id")
    return {
        "substancia": read("customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("nome"), F.concat(F.lit("C"), F.col("c_nationkey")).alias("cui"), F.lit(None).cast("string").alias("drugbank"), F.lit(None).cast("string").alias("mesh"), F.lower("c_mktsegment").alias("aliases")),
        "documento": o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("doc_"), F.col("o_orderkey")).alias("ficheiro"), F.col("o_orderpriority").alias("medicamento"), F.col("o_custkey").alias("substancia_id"), F.col("o_orderstatus").alias("codigo_atc"), F.lit(None).cast("string").alias("grupo_codigo"), (F.col("o_orderstatus") == "F").cast("int").alias("tem_pgx"), (F.col("o_orderstatus") != "O").cast("int").alias("tem_entidades")),
        "entidade": rows.groupBy(*entity).agg(F.min("gene").alias("gene"), F.sum("n").alias("mencoes")).select(key.alias("id"), *entity, "gene", "mencoes"),
        "entidade_seccao": rows.groupBy(*entity, "seccao").agg(F.sum("n").alias("mencoes")).select(key.alias("entidade_id"), "seccao", "mencoes"),
        "passagem": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("documento_id"), F.col("o_orderstatus").alias("seccao"), F.col("o_orderpriority").alias("texto")),
        "guideline": guides,
        "cobertura": cover.select("documento_id", "guideline_id", F.when(F.col("y"), "coberta").otherwise("ausente").alias("estado"), F.when(~F.col("y"), F.col("w")).alias("genes_em_falta")),
    }


#: The star store as common table expressions.
STAR_SQL = """
    substancia AS (SELECT c_custkey AS id, lower(c_name) AS nome, 'C' || c_nationkey AS cui, NULL::VARCHAR AS drugbank, NULL::VARCHAR AS mesh, lower(c_mktsegment) AS aliases FROM customer),
    documento AS (SELECT o_orderkey AS id, 'doc_' || o_orderkey AS ficheiro, o_orderpriority AS medicamento, o_custkey AS substancia_id, o_orderstatus AS codigo_atc, NULL::VARCHAR AS grupo_codigo,
        (o_orderstatus = 'F')::INT AS tem_pgx, (o_orderstatus <> 'O')::INT AS tem_entidades FROM orders),
    mention AS (SELECT l_orderkey AS documento_id, CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'N' THEN 'alelo' ELSE 'diplotipo' END AS tipo, p_name AS valor, p_brand AS gene, l_linestatus AS seccao, l_quantity::BIGINT AS n, l_suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    entidade AS (SELECT concat_ws('|', documento_id, tipo, valor) AS id, documento_id, tipo, valor, min(gene) AS gene, sum(n)::BIGINT AS mencoes FROM mention GROUP BY documento_id, tipo, valor),
    entidade_seccao AS (SELECT concat_ws('|', documento_id, tipo, valor) AS entidade_id, seccao, sum(n)::BIGINT AS mencoes FROM mention GROUP BY documento_id, tipo, valor, seccao),
    passagem AS (SELECT o_orderkey AS id, o_orderkey AS documento_id, o_orderstatus AS seccao, o_orderpriority AS texto FROM orders),
    guideline AS (SELECT s_suppkey AS id, 'PA' || s_nationkey AS guideline_id, CASE WHEN s_nationkey % 2 = 0 THEN 'CPIC' ELSE 'DPWG' END AS fonte, s_name AS farmaco, 'Brand#' || (s_suppkey % 25 + 1) AS gene FROM supplier),
    cobertura AS (SELECT documento_id, l_suppkey AS guideline_id, CASE WHEN bool_or(m.gene = g.gene) THEN 'coberta' ELSE 'ausente' END AS estado, CASE WHEN NOT bool_or(m.gene = g.gene) THEN min(g.gene) END AS genes_em_falta
        FROM mention m JOIN guideline g ON g.id = m.l_suppkey GROUP BY documento_id, l_suppkey)"""
