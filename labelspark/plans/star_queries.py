"""Queries over the star schema in the roles of the label store, and over events as mentions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import entities as ent
from labelspark.functions.text import fold
from labelspark.operators import agreement, analysis, dedup
from labelspark.plans import api, statements, store
from labelspark.plans.registry import query, read
from labelspark.sources.readers import latest
from labelspark.streaming import incremental

_S = "WITH " + store.STAR_SQL


def _mentions(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    kind = F.when(F.col("l_returnflag") == "A", "gene").when(F.col("l_returnflag") == "N", "alelo").otherwise("diplotipo")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), kind.alias("kind"), F.col("p_name").alias("value"), F.col("p_brand").alias("gene"), F.col("l_linestatus").alias("section"), F.col("l_quantity").cast("long").alias("n"), F.col("l_shipdate"), F.col("l_returnflag"))


@query("""WITH m AS (SELECT l_orderkey AS doc, p_name AS entity, l_quantity::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT count(*) AS d, count_if(o_orderstatus = 'F') AS f FROM orders)
    SELECT entity, count(DISTINCT doc) AS n_docs, sum(n)::BIGINT AS n_mentions, round(100.0 * count(DISTINCT doc) / any_value(d), 1)::DOUBLE AS pct_docs, round(100.0 * count(DISTINCT doc) / any_value(f), 1)::DOUBLE AS pct_pgx FROM m, t GROUP BY entity""")
def entity_frequency(spark, sf_dir):
    n = read(spark, sf_dir, "orders").agg(F.count("*").alias("d"), F.count_if(F.col("o_orderstatus") == "F").alias("f")).first()
    m = _mentions(spark, sf_dir).select("doc", F.col("value").alias("entity"), "n")
    return analysis.frequency(m, "entity", n.d, n.f)


@query("""WITH m AS (SELECT l_orderkey AS doc, l_returnflag = 'A' AS direct, p_brand AS gene, l_quantity::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT gene, coalesce(sum(n) FILTER (direct), 0)::BIGINT AS direct, coalesce(sum(n) FILTER (NOT direct), 0)::BIGINT AS through, sum(n)::BIGINT AS total, count(DISTINCT doc) AS n_docs FROM m GROUP BY gene""")
def gene_rollup(spark, sf_dir):
    return analysis.gene_rollup(_mentions(spark, sf_dir))


@query("""WITH e AS (SELECT event_type AS section, user_id AS doc, user_id % 2 = 0 AS g FROM events)
    SELECT section, count(DISTINCT doc) AS n_docs, count_if(g)::BIGINT AS n_gene, count_if(NOT g)::BIGINT AS n_alelo, count(*) AS n_mentions, round(100.0 * count(*) / (SELECT count(*) FROM e), 1)::DOUBLE AS pct_mentions FROM e GROUP BY section""")
def section_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("section"), F.col("user_id").alias("doc"), F.when(F.col("user_id") % 2 == 0, "gene").otherwise("alelo").alias("kind"), F.lit(1).alias("n"))
    return analysis.section_summary(e, ("gene", "alelo"))


@query("""WITH d AS (SELECT o_orderkey AS doc, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey::VARCHAR END AS code, nullif(c_mktsegment, 'AUTOMOBILE') AS label, o_orderstatus = 'F' AS pgx FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT coalesce(code, label, '(sem grupo)') AS "group", max_by(label, length(label)::VARCHAR || label) AS label, count(DISTINCT doc) AS n_docs, count(DISTINCT CASE WHEN pgx THEN doc END) AS n_pgx,
        round(100.0 * count(DISTINCT CASE WHEN pgx THEN doc END) / count(DISTINCT doc), 1)::DOUBLE AS pct_pgx FROM d GROUP BY 1""")
def group_summary(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(F.col("o_orderkey").alias("doc"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey").cast("string")).alias("code"), F.nullif("c_mktsegment", F.lit("AUTOMOBILE")).alias("label"), (F.col("o_orderstatus") == "F").alias("has_pgx"))
    return analysis.group_summary(d)


def _covered(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    expected = s.select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("guideline"), F.explode(F.array(*[F.concat(F.lit("Brand#"), ((F.col("s_suppkey") * k) % 25 + 1).cast("string")) for k in (1, 3, 7)])).alias("gene"))
    l, p = read(spark, sf_dir, "lineitem").filter("l_quantity > 45"), read(spark, sf_dir, "part")
    seen = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("p_size > 40").select(F.col("s_nationkey").alias("doc"), F.col("p_brand").alias("gene"))
    return analysis.coverage(expected, seen)


_COV = """e AS (SELECT DISTINCT s_nationkey AS doc, s_suppkey AS guideline, 'BRAND#' || (s_suppkey * k % 25 + 1) AS gene FROM supplier, (VALUES (1), (3), (7)) t(k)),
    o AS (SELECT DISTINCT s_nationkey AS doc, upper(p_brand) AS gene FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 AND p_size > 40),
    pos AS (SELECT e.*, o.gene IS NOT NULL AS y, doc % 7 AS substance FROM e LEFT JOIN o USING (doc, gene))"""


@query(f"""WITH {_COV} SELECT doc, guideline, list_sort(list(gene)) AS expected, coalesce(list_sort(list(gene) FILTER (y)), []) AS covered, coalesce(list_sort(list(gene) FILTER (NOT y)), []) AS missing,
    CASE WHEN bool_and(y) THEN 'coberta' WHEN bool_or(y) THEN 'parcial' ELSE 'ausente' END AS status FROM pos GROUP BY doc, guideline""")
def coverage_pairs(spark, sf_dir):
    return _covered(spark, sf_dir)


def _positions(spark, sf_dir):
    c = _covered(spark, sf_dir)
    return analysis.coverage_positions(c, c.select("doc", (F.col("doc") % 7).alias("substance")).distinct())


@query(f"""WITH {_COV}, f AS (SELECT doc, guideline, bool_and(y) AS a, count(*) AS n, count_if(y) AS c FROM pos GROUP BY ALL), d AS (SELECT doc, count(*) AS p, count_if(a) AS pc, sum(n) AS n, sum(c) AS c FROM f GROUP BY doc),
    dg AS (SELECT doc, gene, bool_or(y) AS x FROM pos GROUP BY ALL), sg AS (SELECT substance, gene, bool_or(y) AS x FROM pos GROUP BY ALL),
    a AS (SELECT sum(p)::BIGINT AS pairs, sum(pc)::BIGINT AS pairs_covered, sum(n)::BIGINT AS positions, sum(c)::BIGINT AS positions_covered, count(*) AS docs, count_if(p = pc)::BIGINT AS docs_full,
        count_if(c > 0 AND pc < p)::BIGINT AS docs_partial, count_if(c = 0)::BIGINT AS docs_none FROM d),
    b AS (SELECT count(*) AS doc_genes, count_if(x)::BIGINT AS doc_genes_covered FROM dg), g AS (SELECT count(*) AS substance_genes, count_if(x)::BIGINT AS substance_genes_covered FROM sg)
    SELECT *, round(100.0 * pairs_covered / pairs, 1)::DOUBLE AS pct_pairs, round(100.0 * positions_covered / positions, 1)::DOUBLE AS pct_positions, round(100.0 * doc_genes_covered / doc_genes, 1)::DOUBLE AS pct_doc_genes,
        round(100.0 * substance_genes_covered / substance_genes, 1)::DOUBLE AS pct_substance_genes FROM a, b, g""")
def coverage_grains(spark, sf_dir):
    return analysis.coverage_grains(_positions(spark, sf_dir))


@query(f"""WITH {_COV} SELECT gene, count(DISTINCT doc) AS docs_expected, count(DISTINCT CASE WHEN y THEN doc END) AS docs_covered, count(*) AS expected, count_if(y)::BIGINT AS covered,
    round(100.0 * count(DISTINCT CASE WHEN y THEN doc END) / count(DISTINCT doc), 1)::DOUBLE AS pct_docs, round(100.0 * count_if(y) / count(*), 1)::DOUBLE AS pct_positions FROM pos GROUP BY gene""")
def coverage_by_gene(spark, sf_dir):
    return analysis.coverage_by_gene(_positions(spark, sf_dir))


@query(f"""WITH {_COV}, d AS (SELECT doc, list_sort(list(DISTINCT guideline)) AS g, list_sort(list(DISTINCT gene)) AS e, coalesce(list_sort(list(DISTINCT gene) FILTER (y)), []) AS c FROM pos GROUP BY doc)
    SELECT doc, array_to_string(g, ' ; ') AS guidelines, array_to_string(e, ' ; ') AS expected, array_to_string(c, ' ; ') AS covered, array_to_string(list_filter(e, lambda x: NOT list_contains(c, x)), ' ; ') AS missing, round(100.0 * len(c) / len(e), 1)::DOUBLE AS pct FROM d""")
def document_guidelines(spark, sf_dir):
    return analysis.document_guidelines(_covered(spark, sf_dir))


@query(_S + """SELECT (SELECT count(*) FROM documento) AS documentos, (SELECT count(*) FROM substancia) AS substancias, (SELECT count(*) FROM entidade) AS entidades, (SELECT sum(mencoes)::BIGINT FROM entidade) AS mencoes,
    (SELECT count(*) FROM passagem) AS passagens, (SELECT count(*) FROM documento WHERE tem_pgx = 1) AS documentos_com_pgx, (SELECT count(DISTINCT guideline_id) FROM guideline) AS guidelines, (SELECT count(*) FROM cobertura WHERE estado = 'ausente') AS posicoes_em_falta""")
def stats_scalar(spark, sf_dir):
    return api.statistics(store.star_store(spark, sf_dir))


_LIST = """SELECT s.nome, s.cui, s.drugbank, s.mesh, count(d.id) AS documentos FROM substancia s LEFT JOIN documento d ON d.substancia_id = s.id {} GROUP BY ALL ORDER BY documentos DESC, nome LIMIT {}"""


@query(_S + _LIST.format("", 100))
def substance_list(spark, sf_dir):
    return api.substances(store.star_store(spark, sf_dir))


@query(_S + _LIST.format("WHERE s.nome ILIKE '%07%' OR s.aliases ILIKE '%07%'", 1000))
def substance_search(spark, sf_dir):
    return api.substances(store.star_store(spark, sf_dir), "07", 5000)


_DOCS = "JOIN documento d ON d.id = documento_id WHERE d.substancia_id = 7"


@query(_S + f""", s AS (SELECT e.tipo, e.valor, array_to_string(list_sort(list(DISTINCT es.seccao)), ',') AS seccoes FROM entidade e JOIN entidade_seccao es ON es.entidade_id = e.id {_DOCS} GROUP BY ALL)
    SELECT e.tipo, e.valor, e.gene, sum(e.mencoes)::BIGINT AS mencoes, any_value(s.seccoes) AS seccoes, CASE e.tipo WHEN 'gene' THEN 0 WHEN 'alelo' THEN 1 WHEN 'diplotipo' THEN 2 ELSE 3 END AS ordem_tipo
    FROM entidade e LEFT JOIN s USING (tipo, valor) {_DOCS} GROUP BY e.tipo, e.valor, e.gene""")
def substance_detail(spark, sf_dir):
    return api.substance(store.star_store(spark, sf_dir), "Customer#000000007")[2]


@query(_S + "SELECT * EXCLUDE (id) FROM substancia WHERE id = 7")
def substance_row(spark, sf_dir):
    return api.substance(store.star_store(spark, sf_dir), "Customer#000000007")[0].drop("id")


@query(_S + f"SELECT ficheiro, medicamento, codigo_atc, tem_pgx, tem_entidades FROM documento WHERE substancia_id = 7")
def substance_documents(spark, sf_dir):
    return api.substance(store.star_store(spark, sf_dir), "Customer#000000007")[1]


@query(_S + """SELECT g.guideline_id, g.fonte, g.gene, c.estado, count(DISTINCT d.id) AS documentos FROM cobertura c JOIN guideline g ON g.id = c.guideline_id JOIN documento d ON d.id = c.documento_id WHERE d.substancia_id = 7 GROUP BY ALL""")
def substance_coverage(spark, sf_dir):
    return api.substance(store.star_store(spark, sf_dir), "Customer#000000007")[3]


@query(_S + "SELECT gene, count(DISTINCT documento_id) AS documentos, sum(mencoes)::BIGINT AS mencoes FROM entidade WHERE gene IS NOT NULL GROUP BY gene ORDER BY mencoes DESC, gene LIMIT 10")
def gene_ranking(spark, sf_dir):
    return api.genes(store.star_store(spark, sf_dir), 10)


@query(_S + """, x AS (SELECT entidade_id, array_to_string(list_sort(list(DISTINCT seccao)), ',') AS seccoes FROM entidade_seccao GROUP BY entidade_id)
    SELECT d.ficheiro, d.medicamento, s.nome AS substancia, e.tipo, e.valor, e.mencoes, x.seccoes FROM entidade e JOIN documento d ON d.id = e.documento_id LEFT JOIN substancia s ON s.id = d.substancia_id LEFT JOIN x ON x.entidade_id = e.id
    WHERE upper(e.gene) = 'BRAND#7' ORDER BY e.mencoes DESC, ficheiro, tipo, valor LIMIT 100""")
def gene_detail(spark, sf_dir):
    return api.gene(store.star_store(spark, sf_dir), "brand#7")


_COVER = """SELECT s.nome AS substancia, g.gene, g.fonte, g.guideline_id, c.estado, count(DISTINCT d.id) AS rotulos FROM cobertura c JOIN guideline g ON g.id = c.guideline_id JOIN documento d ON d.id = c.documento_id
    LEFT JOIN substancia s ON s.id = d.substancia_id WHERE {} GROUP BY ALL ORDER BY rotulos DESC, substancia, gene, guideline_id, estado LIMIT {}"""


@query(_S + _COVER.format("true", 100))
def coverage_listing(spark, sf_dir):
    return api.coverage(store.star_store(spark, sf_dir))


@query(_S + _COVER.format("g.gene = 'Brand#3' AND c.estado = 'ausente' AND g.fonte = 'CPIC'", 50))
def coverage_filtered(spark, sf_dir):
    return api.coverage(store.star_store(spark, sf_dir), "Brand#3", "ausente", "CPIC", 50)


@query(_S + """SELECT g.gene, count(*) AS exigido_em, count_if(c.estado = 'coberta')::BIGINT AS coberto_em, count_if(c.estado = 'ausente')::BIGINT AS ausente_em, round(100.0 * count_if(c.estado = 'coberta') / count(*), 1)::DOUBLE AS pct_coberto
    FROM cobertura c JOIN guideline g ON g.id = c.guideline_id GROUP BY g.gene""")
def api_coverage_by_gene(spark, sf_dir):
    return api.coverage_by_gene(store.star_store(spark, sf_dir))


@query(_S + "SELECT g.gene, count(*) AS exigido_em, count_if(c.estado = 'ausente')::BIGINT AS ausente_em FROM cobertura c JOIN guideline g ON g.id = c.guideline_id GROUP BY g.gene ORDER BY exigido_em DESC, gene LIMIT 6")
def required_genes(spark, sf_dir):
    return api.required_genes(store.star_store(spark, sf_dir))


@query(_S + "SELECT d.*, s.nome AS substancia, s.cui, s.drugbank, s.mesh FROM documento d LEFT JOIN substancia s ON s.id = d.substancia_id WHERE d.ficheiro = 'doc_42'")
def document_detail(spark, sf_dir):
    return api.document(store.star_store(spark, sf_dir), "doc_42")[0]


@query(_S + """, x AS (SELECT entidade_id, array_to_string(list_sort(list(DISTINCT seccao)), ',') AS seccoes FROM entidade_seccao GROUP BY entidade_id)
    SELECT e.tipo, e.valor, e.gene, e.mencoes, x.seccoes, CASE e.tipo WHEN 'gene' THEN 0 WHEN 'alelo' THEN 1 WHEN 'diplotipo' THEN 2 ELSE 3 END AS ordem_tipo FROM entidade e LEFT JOIN x ON x.entidade_id = e.id WHERE e.documento_id = 42""")
def document_entities(spark, sf_dir):
    return api.document(store.star_store(spark, sf_dir), "doc_42")[1]


@query(_S + "SELECT seccao, texto FROM passagem WHERE documento_id = 42")
def document_passages(spark, sf_dir):
    return api.document(store.star_store(spark, sf_dir), "doc_42")[2]


@query(_S + "SELECT es.seccao, count(*) AS entidades, sum(es.mencoes)::BIGINT AS mencoes, count(DISTINCT e.documento_id) AS documentos FROM entidade_seccao es JOIN entidade e ON e.id = es.entidade_id GROUP BY es.seccao")
def section_distribution(spark, sf_dir):
    return api.sections(store.star_store(spark, sf_dir))


@query(_S + """, x AS (SELECT entidade_id, array_to_string(list_sort(list(DISTINCT seccao)), ' ; ') AS seccoes FROM entidade_seccao GROUP BY entidade_id)
    SELECT e.id, e.tipo, e.valor, e.gene, x.seccoes, e.mencoes, d.ficheiro, d.medicamento, d.codigo_atc, d.grupo_codigo, s.nome AS substancia, s.cui, s.drugbank
    FROM entidade e JOIN documento d ON d.id = e.documento_id LEFT JOIN substancia s ON s.id = d.substancia_id LEFT JOIN x ON x.entidade_id = e.id""")
def complete_view(spark, sf_dir):
    return store.complete_view(store.star_store(spark, sf_dir))


@query(_S + " SELECT t AS tabela, n, n = 0 AS vazia FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in store.TABLES) + ")")
def table_counts(spark, sf_dir):
    return store.table_counts(store.star_store(spark, sf_dir))


@query(_S + "SELECT e.id, e.mencoes, s.n AS por_seccao FROM entidade e JOIN (SELECT entidade_id, sum(mencoes)::BIGINT AS n FROM entidade_seccao GROUP BY entidade_id) s ON s.entidade_id = e.id WHERE s.n > e.mencoes")
def store_consistency(spark, sf_dir):
    return store.inconsistent_totals(store.star_store(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def store_orphans(spark, sf_dir):
    return store.orphans(read(spark, sf_dir, "lineitem"), "l_orderkey", read(spark, sf_dir, "orders"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT row_number() OVER (ORDER BY c_name) AS id, c_name FROM customer")
def surrogate_ids(spark, sf_dir):
    return statements.numbered(read(spark, sf_dir, "customer").select("c_name"), ["c_name"])


@query("SELECT n_nationkey, concat('(', n_nationkey, ', ''', replace(n_name, '''', ''''''), ''', ', n_regionkey, ')') AS row FROM nation")
def dump_literals(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.concat(F.lit("("), F.concat_ws(", ", statements.literal(F.col("n_nationkey"), True), statements.literal(F.col("n_name"), False), statements.literal(F.col("n_regionkey"), True)), F.lit(")")).alias("row"))


def _statements_sql(table: str, columns: str, row: str, order: str) -> str:
    """Statements by their meaning: one begins at row 0, and the next where a row is one too many or would make it too long."""
    return f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS i, {row} AS t FROM {table}),
        c AS (SELECT i, t, length(t) AS len, sum(length(t) + 2) OVER (ORDER BY i) - length(t) - 2 AS before FROM r),
        ends AS (SELECT a.i, coalesce(min(b.i), a.i + 200) AS after FROM c a LEFT JOIN c b ON b.i > a.i AND b.i <= a.i + 200 AND (b.i = a.i + 200 OR b.before - a.before + b.len > 25000) GROUP BY a.i),
        starts AS (SELECT 0::BIGINT AS batch, 0::BIGINT AS i WHERE EXISTS (FROM r) UNION ALL SELECT batch + 1, after FROM starts JOIN ends USING (i) WHERE after < (SELECT count(*) FROM r))
        SELECT s.batch, count(*) AS n_rows, 'INSERT INTO {table} ({columns}) VALUES' || chr(10) || string_agg(t, ',' || chr(10) ORDER BY c.i) || ';' AS statement
        FROM starts s JOIN ends e USING (i) JOIN c ON c.i >= s.i AND c.i < e.after GROUP BY s.batch"""


@query(_statements_sql("orders", "o_orderkey, o_orderpriority", "concat('(', o_orderkey, ', ''', o_orderpriority, ''')')", "o_orderkey"))
def dump_batches(spark, sf_dir):
    return statements.insert_batches(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "orders", "o_orderkey")


@query(_statements_sql("documents", "doc_id, source, text", "concat('(', doc_id, ', ', coalesce(chr(39) || source || chr(39), 'NULL'), ', ', coalesce(chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39), 'NULL'), ')')", "doc_id"))
def dump_documents(spark, sf_dir):
    """Rows between a few and some ten thousand characters: statements end by length."""
    return statements.insert_batches(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "documents", "doc_id")


@query("""WITH h AS (SELECT event_id % 2 AS run, user_id AS doc, string_agg(event_type, ',' ORDER BY event_id) AS raw, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS ents FROM events GROUP BY ALL),
    b AS (SELECT doc, count(DISTINCT run) AS r, count(DISTINCT raw) AS a, count(DISTINCT ents) AS e FROM h GROUP BY doc)
    SELECT count(*) AS n_docs, count_if(a = 1)::BIGINT AS n_raw, count_if(e = 1)::BIGINT AS n_entities, coalesce(round(100.0 * count_if(a = 1) / nullif(count(*), 0), 1), 0)::DOUBLE AS tar_raw, coalesce(round(100.0 * count_if(e = 1) / nullif(count(*), 0), 1), 0)::DOUBLE AS tar_entities FROM b WHERE r = 2""")
def run_agreement(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 2)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
    h = e.groupBy("run", F.col("user_id").alias("doc")).agg(raw.alias("raw"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("entities"))
    return agreement.run_agreement(h, "raw", "entities")


@query("""WITH h AS (SELECT event_id % 2 AS run, user_id AS doc, event_type AS section, count(*)::VARCHAR AS raw FROM events GROUP BY ALL), d AS (SELECT doc, section FROM h GROUP BY ALL HAVING count(DISTINCT raw) > 1 OR count(DISTINCT run) < 2)
    SELECT doc, list_sort(list(section))[1:3] AS sections, count(*) AS n_sections FROM d GROUP BY doc""")
def run_differences(spark, sf_dir):
    h = read(spark, sf_dir, "events").groupBy((F.col("event_id") % 2).alias("run"), F.col("user_id").alias("doc"), F.col("event_type").alias("section")).agg(F.count("*").cast("string").alias("raw"))
    return agreement.diverging(h, "raw")


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0),
    g AS (SELECT user_id, event_type, 'r' AS k FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, event_type, 'a' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
    SELECT user_id, coalesce(list_sort(list(event_type) FILTER (k = 'r')), []) AS removed, coalesce(list_sort(list(event_type) FILTER (k = 'a')), []) AS added FROM g GROUP BY user_id""")
def assoc_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return agreement.association_diff(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"), "user_id", "event_type")


_FORM = "CASE WHEN regexp_matches(p_name, '^small') THEN 'small' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'outro' END"


@query(f"""WITH f AS (SELECT p_brand AS kind, {_FORM} AS form, count(DISTINCT p_name) AS n_entities, sum(p_size)::BIGINT AS n_mentions FROM part GROUP BY ALL)
    SELECT *, round(100.0 * n_mentions / sum(n_mentions) OVER (PARTITION BY kind), 1)::DOUBLE AS pct FROM f""")
def form_classes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_name").alias("value"), F.col("p_size").alias("n"))
    return analysis.forms(p, ent._first_form(F.col("value"), (("^small", "small"), ("ring$", "ring"))))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // ceil((SELECT count(*) FROM orders) / 7.0)::BIGINT)::BIGINT AS lot FROM orders")
def lots(spark, sf_dir):
    return dedup.lots(read(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
    SELECT l_returnflag, len(v)::BIGINT AS n, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS middle, v[3 * len(v) // 4 + 1] AS q3, list_median(v) AS median FROM s""".replace("list_median(v)", "list_aggregate(v, 'median')"))
def index_median(spark, sf_dir):
    return agreement.order_statistics(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT lower(p_name) AS folded, arg_min(p_name, p_partkey) AS p_name, count(*) AS n FROM part GROUP BY 1")
def normalise_distinct(spark, sf_dir):
    return agreement.distinct_forms(read(spark, sf_dir, "part"), "p_name", fold(F.col("p_name")), "p_partkey")


@query("SELECT p_brand, count(DISTINCT lower(p_name)) AS n_forms, count(*) AS n_mentions FROM part GROUP BY p_brand")
def forms_per_symbol(spark, sf_dir):
    return agreement.forms_per_symbol(read(spark, sf_dir, "part"), "p_brand", "p_name")


@query("""WITH k AS (SELECT p_name FROM part WHERE p_size <= 45) SELECT p_brand FROM part GROUP BY p_brand HAVING bool_and(p_name IN (SELECT p_name FROM k))""")
def only_expanded(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return agreement.only_expanded(p, p.filter("p_size <= 45").select("p_name").distinct(), "p_brand", "p_name")


_ITEMS = """i AS (SELECT l_orderkey AS doc, CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'N' THEN 'alelo' ELSE 'diplotipo' END AS kind, p_name AS value, p_brand AS gene, l_linestatus AS section, l_quantity::BIGINT AS n, p_size > 25 AS guideline, CASE WHEN p_size > 40 THEN 'tabela_1' ELSE 'content' END AS origin
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _items(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    kind = F.when(F.col("l_returnflag") == "A", "gene").when(F.col("l_returnflag") == "N", "alelo").otherwise("diplotipo")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), kind.alias("kind"), F.col("p_name").alias("value"), F.col("p_brand").alias("gene"), F.col("l_linestatus").alias("section"), F.col("l_quantity").cast("long").alias("n"), (F.col("p_size") > 25).alias("guideline"), F.when(F.col("p_size") > 40, "tabela_1").otherwise("content").alias("origin"))


@query(f"WITH {_ITEMS} SELECT doc, section, kind, value, sum(n)::BIGINT AS n FROM i GROUP BY ALL")
def section_entities(spark, sf_dir):
    return analysis.section_entities(_items(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT doc, kind, list_sort(list(DISTINCT value)) AS \"values\" FROM i GROUP BY doc, kind")
def unique_entities(spark, sf_dir):
    return analysis.unique_entities(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS} SELECT doc, {', '.join(f"count(DISTINCT value) FILTER (kind = '{k}') AS unique_{k}, coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS mentions_{k}" for k in analysis.KINDS)},
    count(DISTINCT kind || '|' || value) AS unique_total, sum(n)::BIGINT AS mentions_total, count(DISTINCT kind || '|' || value) FILTER (guideline) AS unique_guideline, coalesce(sum(n) FILTER (guideline), 0)::BIGINT AS mentions_guideline FROM i GROUP BY doc""")
def counts_block(spark, sf_dir):
    return analysis.counts_block(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, s AS (SELECT doc, section, kind, value, CASE WHEN kind = 'alelo' THEN max(n) ELSE sum(n) END AS n FROM i GROUP BY doc, section, kind, value)
    SELECT doc, kind, value, sum(n)::BIGINT AS n, list_sort(list(DISTINCT section)) AS sections FROM s GROUP BY doc, kind, value""")
def accumulated(spark, sf_dir):
    return analysis.accumulated(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS} SELECT kind, value, coalesce(sum(n) FILTER (origin = 'content'), 0)::BIGINT AS n_text, coalesce(sum(n) FILTER (origin <> 'content'), 0)::BIGINT AS n_table, count(DISTINCT doc) AS n_docs,
    coalesce(sum(n) FILTER (origin = 'content'), 0) = 0 AND coalesce(sum(n) FILTER (origin <> 'content'), 0) > 0 AS only_tables FROM i GROUP BY kind, value""")
def origins(spark, sf_dir):
    return analysis.origins(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, c AS (SELECT doc % 10 AS substance, kind, value, sum(n) AS n FROM i GROUP BY ALL)
    SELECT substance, {', '.join(f"coalesce(string_agg(value || '=' || n, ' ; ' ORDER BY value) FILTER (kind = '{k}'), '') AS {k}" for k in analysis.KINDS)}, string_agg(value || '=' || n, ' ; ' ORDER BY value, n) AS todas FROM c GROUP BY substance""")
def report_drug_entities(spark, sf_dir):
    i = _items(spark, sf_dir)
    return analysis.report_drug_entities(i, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 10).alias("substance")))


@query(f"""WITH {_ITEMS}, p AS (SELECT doc, list_sort(list(DISTINCT section || '|' || kind || '|' || value)) AS p FROM i GROUP BY doc)
    SELECT o_custkey AS substance, count(DISTINCT o_orderkey) AS n_docs, count(DISTINCT coalesce(p::VARCHAR, '')) AS n_profiles, count(DISTINCT coalesce(p::VARCHAR, '')) = 1 AS uniform FROM orders LEFT JOIN p ON p.doc = o_orderkey GROUP BY o_custkey""")
def profile_equality(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("substance"))
    return agreement.profile_equality(d, _items(spark, sf_dir))


_PROFILE = """p AS (SELECT o_orderkey AS doc, o_orderstatus = 'F' AS has_pgx, coalesce(u, 0) > 2 AS has_entities, o_orderkey % 5 = 0 AS has_guideline, coalesce(u, 0) AS n_unique, coalesce(m, 0) AS n_mentions, o_orderpriority <> '5-LOW' AS usable
    FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS u, sum(l_quantity)::BIGINT AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _profile_rows(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("u"), F.sum("l_quantity").cast("long").alias("m"))
    o = read(spark, sf_dir, "orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    u = F.coalesce("u", F.lit(0))
    return o.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderstatus") == "F").alias("has_pgx"), (u > 2).alias("has_entities"), (F.col("o_orderkey") % 5 == 0).alias("has_guideline"), u.alias("n_unique"), F.coalesce("m", F.lit(0)).alias("n_mentions"), (F.col("o_orderpriority") != "5-LOW").alias("usable"))


_PROFILE_SQL = f"""WITH {_PROFILE} SELECT count_if(usable)::BIGINT AS n_docs, count_if(NOT usable)::BIGINT AS n_unusable, count_if(usable AND has_pgx)::BIGINT AS n_pgx, count_if(usable AND NOT has_pgx)::BIGINT AS n_without_pgx, count_if(usable AND has_entities)::BIGINT AS n_entities,
    count_if(usable AND has_pgx AND NOT has_entities)::BIGINT AS n_pgx_without_entities, count_if(usable AND NOT has_pgx AND has_entities)::BIGINT AS n_entities_without_pgx, count_if(usable AND has_guideline)::BIGINT AS n_guideline,
    count_if(usable AND has_guideline AND has_entities)::BIGINT AS n_guideline_entities, count_if(usable AND has_guideline AND NOT has_pgx)::BIGINT AS n_guideline_without_pgx, sum(n_unique) FILTER (usable)::BIGINT AS unique_total, sum(n_mentions) FILTER (usable)::BIGINT AS mentions_total,
    round(100.0 * count_if(usable AND has_pgx) / count_if(usable), 1)::DOUBLE AS pct_pgx, round(100.0 * count_if(usable AND has_entities) / count_if(usable AND has_pgx), 1)::DOUBLE AS pct_entities_of_pgx FROM p""".replace("sum(n_unique) FILTER (usable)::BIGINT", "(sum(n_unique) FILTER (usable))::BIGINT").replace("sum(n_mentions) FILTER (usable)::BIGINT", "(sum(n_mentions) FILTER (usable))::BIGINT")


@query(_PROFILE_SQL)
def corpus_profile(spark, sf_dir):
    return analysis.profile(_profile_rows(spark, sf_dir))


@query(f"""WITH {_PROFILE}, n AS (SELECT count_if(has_pgx) AS p, count_if(has_pgx AND has_entities) AS w, sum(n_mentions) AS m, sum(n_unique) AS u FROM p)
    SELECT unnest(['com_entidades', 'sem_entidades', 'ocorrencias', 'unicas']) AS metric, unnest([w, p - w, m, u])::BIGINT AS value FROM n""")
def report_with_without(spark, sf_dir):
    return analysis.report_with_without(_profile_rows(spark, sf_dir))


@query(f"""WITH {_PROFILE} SELECT d.doc_id AS doc, CASE WHEN p.doc IS NULL THEN NULL WHEN has_pgx THEN 'Sim' ELSE 'Não' END AS has_pgx, CASE WHEN p.doc IS NULL THEN NULL WHEN has_entities THEN 'Sim' ELSE 'Não' END AS has_entities, CASE WHEN p.doc IS NULL THEN 'sem resultado' ELSE 'analisado' END AS status
    FROM documents d LEFT JOIN (SELECT * FROM p WHERE doc % 2 = 0) p ON p.doc = d.doc_id""")
def report_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return analysis.report_documents(d, _profile_rows(spark, sf_dir).filter("doc % 2 = 0").select("doc", "has_pgx", "has_entities"), ["has_pgx", "has_entities"])


@query("SELECT o.* FROM orders o ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) l ON l_orderkey = o_orderkey")
def resume_pending(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.pending(read(spark, sf_dir, "orders"), done, "o_orderkey")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return latest(read(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""WITH k AS (SELECT p_brand, CASE WHEN trim(p_type) = '' THEN '' ELSE p_type END AS a, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS b FROM part)
    SELECT CASE WHEN trim(a) = '' OR trim(b) = '' THEN 'em falta' WHEN lower(a) = lower(b) THEN 'igual' ELSE 'diferente' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def holder_agreement(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_type").alias("a"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("b"))
    return dedup.holder_agreement(p, "a", "b")


@query("""WITH x AS (SELECT c_custkey, c_custkey % 11 AS representative FROM customer), e AS (SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0), r AS (SELECT 3 AS o, 103 AS n)
    SELECT x.c_custkey, coalesce(r.n, x.representative)::BIGINT AS representative FROM x LEFT JOIN r ON r.o = x.representative WHERE x.c_custkey NOT IN (SELECT c_custkey FROM e)""")
def corpus_scenario(spark, sf_dir):
    x = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 11).alias("representative"))
    replaced = spark.range(1).select(F.lit(3).cast("long").alias("old"), F.lit(103).cast("long").alias("new"))
    return dedup.scenario(x, "c_custkey", "B", x.filter("c_custkey % 13 = 0").select("c_custkey"), replaced)


@query("SELECT o_orderpriority AS status, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS ok FROM orders GROUP BY 1")
def status_tally(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))


@query(_S + """, d AS (SELECT count(*) AS n, count_if(tem_pgx = 1) AS p, count_if(tem_entidades = 1) AS e FROM documento), c AS (SELECT g.fonte, count(*) AS n, count_if(c.estado = 'coberta') AS c FROM cobertura c JOIN guideline g ON g.id = c.guideline_id GROUP BY 1)
    SELECT 'pct_pgx' AS metric, NULL::VARCHAR AS key, round(100.0 * p / n, 1)::DOUBLE AS value FROM d UNION ALL SELECT 'pct_entidades', NULL, round(100.0 * e / n, 1)::DOUBLE FROM d
    UNION ALL SELECT 'entidades', tipo, count(DISTINCT valor)::DOUBLE FROM entidade GROUP BY tipo UNION ALL SELECT 'mencoes', tipo, sum(mencoes)::DOUBLE FROM entidade GROUP BY tipo
    UNION ALL SELECT 'pct_seccao', seccao, round(100.0 * sum(mencoes) / (SELECT sum(mencoes) FROM entidade_seccao), 1)::DOUBLE FROM entidade_seccao GROUP BY seccao
    UNION ALL SELECT 'pct_coberto', NULL, round(100.0 * sum(c) / sum(n), 1)::DOUBLE FROM c UNION ALL SELECT 'pct_coberto_fonte', fonte, round(100.0 * c / n, 1)::DOUBLE FROM c
    UNION ALL SELECT 'passagens', 'urgent', count_if(contains(lower(texto), 'urgent'))::DOUBLE FROM passagem""")
def store_metrics(spark, sf_dir):
    return api.metrics(store.star_store(spark, sf_dir), "urgent")


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY length(l_extendedprice::VARCHAR) DESC, l_linenumber, l_partkey) AS r FROM (SELECT l_orderkey, l_partkey, l_linenumber, printf('%.2f', l_extendedprice) AS l_extendedprice FROM lineitem)) WHERE r = 1")
def longest_version(spark, sf_dir):
    # rows that the SQL's order leaves tied keep the table's order
    pos = F.struct("l_linenumber", "l_partkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", pos.alias("pos"), F.format_string("%.2f", "l_extendedprice").alias("l_extendedprice"))
    return dedup.longest_version(l, ["l_orderkey"], "l_extendedprice", "pos").drop("pos")
