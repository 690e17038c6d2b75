"""Report sheets over the star schema: orders as documents with results, line items as mentions and as expected genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.operators import analysis, reports
from labelspark.plans.registry import query, read
from labelspark.plans.star_queries import _ITEMS, _items

_DOCS = """d AS (SELECT o_orderkey AS doc, (o_custkey % 40)::VARCHAR AS substance, o_orderkey % 17 <> 0 AS usable, o_orderpriority <> '5-LOW' AS has_result, o_orderstatus = 'F' AS has_pgx, o_orderkey % 4 < 2 AS has_entities,
    o_orderkey % 5 = 0 AS has_guideline, o_orderkey % 3 = 0 AS substance_has_guideline, o_orderkey % 4 AS failures, o_custkey % 3 AS non_verbatim, o_orderkey % 7 AS model_normalisations, o_orderkey % 2 AS technical_normalisations,
    (o_orderkey % 6 = 0)::INT AS incomplete_alleles, nullif(o_orderstatus, 'P') AS pipeline_version, nullif(o_orderpriority, '1-URGENT') AS model_config FROM orders),
    r AS (SELECT * FROM d WHERE usable AND has_result)"""
_COVERED = """pos AS (SELECT e.*, o.doc IS NOT NULL AS seen FROM (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 5 AS guideline, 'G' || (l_partkey % 7) AS gene FROM lineitem) e
        LEFT JOIN (SELECT DISTINCT l_orderkey AS doc, 'G' || l_linenumber AS gene FROM lineitem) o USING (doc, gene)),
    cov AS (SELECT doc, guideline, count(*) AS n, count_if(seen) AS c FROM pos GROUP BY ALL)"""


def _docs(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("doc"), (c % 40).cast("string").alias("substance"), (k % 17 != 0).alias("usable"), (F.col("o_orderpriority") != "5-LOW").alias("has_result"), (F.col("o_orderstatus") == "F").alias("has_pgx"), (k % 4 < 2).alias("has_entities"),
        (k % 5 == 0).alias("has_guideline"), (k % 3 == 0).alias("substance_has_guideline"), (k % 4).alias("failures"), (c % 3).alias("non_verbatim"), (k % 7).alias("model_normalisations"), (k % 2).alias("technical_normalisations"),
        (k % 6 == 0).cast("int").alias("incomplete_alleles"), F.nullif("o_orderstatus", F.lit("P")).alias("pipeline_version"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("model_config"),
    )


def _covered(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    gene = lambda c: F.concat(F.lit("G"), c.cast("string")).alias("gene")
    expected = l.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).alias("guideline"), gene(F.col("l_partkey") % 7))
    return analysis.coverage(expected, l.select(F.col("l_orderkey").alias("doc"), gene(F.col("l_linenumber"))))


def _corpus(spark, sf_dir):
    return reports.corpus(_docs(spark, sf_dir), _items(spark, sf_dir).select("doc", "kind", "value", "n", "guideline"), _covered(spark, sf_dir))


def _counters_sql() -> str:
    count = lambda name, where: f"count_if({where})::BIGINT AS {name}"
    of_r = {
        "with_result": "true", "with_pgx": "has_pgx", "without_pgx": "NOT has_pgx", "pgx_and_entities": "has_pgx AND has_entities", "pgx_without_entities": "has_pgx AND NOT has_entities", "with_guideline": "has_guideline",
        "without_guideline": "NOT has_guideline", "guideline_and_pgx": "has_guideline AND has_pgx", "guideline_without_pgx": "has_guideline AND NOT has_pgx", "substance_with_guideline": "substance_has_guideline",
        "substance_guideline_not_in_label": "substance_has_guideline AND NOT has_guideline", "with_failures": "failures > 0", "with_non_verbatim": "non_verbatim > 0",
    }
    sums = [f"sum({c})::BIGINT AS total_{c}" for c in reports.RESULT["counters"]]
    kinds = [f"count(DISTINCT value) FILTER (kind = '{k}') AS unique_{k}, coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS mentions_{k}" for k in analysis.KINDS]
    return f"""a1 AS (SELECT count_if(usable)::BIGINT AS documents, count_if(NOT usable)::BIGINT AS unusable FROM d), a2 AS (SELECT {', '.join([count(*x) for x in of_r.items()] + sums)} FROM r),
        a3 AS (SELECT {', '.join(kinds)}, sum(n)::BIGINT AS mentions, (sum(n) FILTER (guideline AND kind = 'gene'))::BIGINT AS gene_mentions_with_guideline, (sum(n) FILTER (guideline))::BIGINT AS mentions_with_guideline FROM i),
        a4 AS (SELECT count(*) AS pairs, count_if(c = n)::BIGINT AS pairs_covered, count_if(c > 0 AND c < n)::BIGINT AS pairs_partial, count_if(c = 0)::BIGINT AS pairs_absent, sum(n)::BIGINT AS positions, sum(c)::BIGINT AS positions_covered FROM cov),
        g AS (SELECT doc, gene, bool_or(seen) AS s FROM pos GROUP BY ALL), g1 AS (SELECT count(*) AS document_genes, count_if(s)::BIGINT AS document_genes_covered FROM g),
        g2 AS (SELECT count(*) AS substance_genes, count_if(s)::BIGINT AS substance_genes_covered FROM (SELECT substance, gene, bool_or(s) AS s FROM g JOIN d USING (doc) GROUP BY ALL)),
        g3 AS (SELECT count_if(s AND NOT f)::BIGINT AS covered_with_missing_genes FROM (SELECT doc, bool_or(s) AS s, bool_and(s) AS f FROM g GROUP BY doc)),
        a5 AS (SELECT count_if(f)::BIGINT AS fully_covered, count_if(NOT f AND NOT a)::BIGINT AS partially_covered, count_if(a)::BIGINT AS not_covered FROM (SELECT doc, bool_and(c = n) AS f, bool_and(c = 0) AS a FROM cov GROUP BY doc)),
        flat AS (SELECT * FROM a1, a2, a3, a4, g1, g2, g3, a5)"""


_SHARES = {
    "pct_pgx": ("with_pgx", "with_result"), "pct_pgx_and_entities": ("pgx_and_entities", "with_result"), "pct_pgx_without_entities": ("pgx_without_entities", "with_result"), "pct_guideline": ("with_guideline", "with_result"),
    "pct_positions": ("positions_covered", "positions"), "pct_document_genes": ("document_genes_covered", "document_genes"), "pct_substance_genes": ("substance_genes_covered", "substance_genes"),
}
_CORPUS = f"WITH {_DOCS}, {_ITEMS}, {_COVERED}, {_counters_sql()}, corpus AS (SELECT *, {', '.join(f'round(100.0 * {a} / {b}, 1)::DOUBLE AS {k}' for k, (a, b) in _SHARES.items())} FROM flat)"


@query(f"{_CORPUS} SELECT * FROM corpus")
def corpus_counters(spark, sf_dir):
    """All counters of the corpus in one row, but for its provenance, which the summary sheet shows."""
    return _corpus(spark, sf_dir).drop("pipeline_version", "model_config")


def _summary_sql() -> str:
    number = lambda c: f"replace(format('{{:,}}', {c}), ',', ' ')"
    share = lambda a, b: f"replace(format('{{:.1f}}', round(100.0 * {a} / {b}, 1)::DOUBLE), '.', ',') || '%'"
    of = lambda a, b: f"{share(a, b)} || ' de ' || {number(b)}"
    notes = {
        "unusable": "'fora de todos os denominadores'", "with_pgx": of("with_pgx", "documents"), "pgx_and_entities": f"{of('pgx_and_entities', 'documents')} || '; ' || {share('pgx_and_entities', 'with_pgx')} || ' dos ' || {number('with_pgx')} || ' com PGx'",
        "mentions_gene": f"'das quais ' || {number('gene_mentions_with_guideline')} || ' em genes com guideline do fármaco'", "mentions": f"'das quais ' || {number('mentions_with_guideline')} || ' com guideline'",
        "with_guideline": of("with_guideline", "substance_with_guideline"), "substance_guideline_not_in_label": of("substance_guideline_not_in_label", "substance_with_guideline"), "pairs_covered": share("pairs_covered", "pairs"), "pairs_absent": share("pairs_absent", "pairs"),
    }
    listed = lambda c: f"(SELECT string_agg(k || '=' || {number('n')}, ' ; ' ORDER BY k) FROM (SELECT {c} AS k, count(*) AS n FROM r WHERE {c} IS NOT NULL GROUP BY 1))"
    other = {"Substância sem guideline": "documents - substance_with_guideline", "Versões do pipeline": listed("coalesce(pipeline_version, 'desconhecida')"), "Configurações do modelo": listed("model_config")}
    rows = []
    for block, lines in reports._blocks():
        for metric, value, _ in lines:
            c = value if isinstance(value, str) else other[metric]
            rows.append(f"SELECT {len(rows)} AS place, '{block}' AS block, '{metric}' AS metric, ({c})::VARCHAR AS value, {notes.get(c, chr(39) * 2)} AS note FROM corpus")
    return f"{_CORPUS} {' UNION ALL '.join(rows)}"


@query(_summary_sql())
def report_summary_blocks(spark, sf_dir):
    """The summary sheet: nine blocks, each with its own denominator."""
    return reports.summary_sheet(_corpus(spark, sf_dir))


@query(_CORPUS + " " + " UNION ALL ".join(f"SELECT '{k}' AS tipo, unique_{k} AS unicas, mentions_{k} AS mencoes FROM corpus" for k in analysis.KINDS))
def report_occurrences(spark, sf_dir):
    return reports.occurrences_sheet(_corpus(spark, sf_dir))


def _sheet_sql() -> str:
    yes = lambda c: f"CASE WHEN r.doc IS NULL THEN NULL WHEN r.{c} THEN 'Sim' ELSE 'Não' END"
    own = {f"{a}_{k}": f"coalesce(m.{a}_{k}, 0)" for k in analysis.KINDS for a in ("unique", "mentions")}
    own |= {c: f"coalesce(v.{c}, '')" for c in ("expected", "covered", "missing")} | {c: f"coalesce(r.{c}, 0)::BIGINT" for c in reports.RESULT["counters"]}
    own |= {"doc": "d.doc::VARCHAR", "substance": "coalesce(r.substance, '')", "pct_covered": "coalesce(v.pct_covered, 0.0)::DOUBLE", "status": "CASE WHEN r.doc IS NULL THEN 'missing_document_unique' ELSE 'analisado' END"}
    cells = []
    for header, name, kind in reports.DOCUMENT_SHEET:
        has = name in own or name in reports.RESULT["flags"]
        c = own.get(name) or (yes(name) if has else "CASE WHEN r.doc IS NOT NULL THEN 'Não' END" if kind == "flag" else "''" if kind in ("text", "list") else "0")
        cells.append(f'{c} AS "{header}"')
    kinds = ", ".join(f"count(DISTINCT value) FILTER (kind = '{k}') AS unique_{k}, coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS mentions_{k}" for k in analysis.KINDS)
    lists = ", ".join(f"coalesce(string_agg(DISTINCT gene, ' ; ' ORDER BY gene) FILTER ({w}), '') AS {n}" for n, w in (("expected", "true"), ("covered", "seen"), ("missing", "NOT seen")))
    return f"""WITH {_DOCS}, {_ITEMS}, {_COVERED}, m AS (SELECT doc, {kinds} FROM i GROUP BY doc),
        v AS (SELECT doc, {lists}, round(100.0 * count(DISTINCT gene) FILTER (seen) / count(DISTINCT gene), 1)::DOUBLE AS pct_covered FROM pos GROUP BY doc)
        SELECT {', '.join(cells)} FROM d LEFT JOIN r USING (doc) LEFT JOIN m ON m.doc = r.doc LEFT JOIN v ON v.doc = r.doc WHERE d.usable"""


@query(_sheet_sql())
def report_documents_sheet(spark, sf_dir):
    """The documents sheet, 36 columns."""
    docs, mentions, covered = _docs(spark, sf_dir).filter("usable"), _items(spark, sf_dir), _covered(spark, sf_dir)
    counts = mentions.groupBy("doc", "kind", "value").agg(F.sum("n").alias("n")).groupBy("doc").agg(
        *[F.count_if(F.col("kind") == k).alias(f"unique_{k}") for k in analysis.KINDS], *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"mentions_{k}") for k in analysis.KINDS]
    )
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    lists = covered.groupBy("doc").agg(flat("expected").alias("expected"), flat("covered").alias("covered"))
    lists = lists.withColumns({"missing": F.array_except("expected", "covered"), "pct_covered": F.round(100.0 * F.size("covered") / F.size("expected"), 1)})
    results = docs.filter("has_result").drop("usable", "has_result", "pipeline_version", "model_config").join(counts, "doc", "left").join(lists, "doc", "left")
    return reports.documents_sheet(docs.select("doc"), results)


@query(f"""WITH {_ITEMS}, l AS (SELECT DISTINCT doc, kind, value FROM i WHERE section = 'O'), n AS (SELECT doc, kind, value, sum(n)::BIGINT AS mentions FROM i WHERE n > 10 GROUP BY ALL)
    SELECT doc, (doc % 10)::VARCHAR AS substance, value AS entity, kind AS type, coalesce(mentions, 0) AS mentions, CASE WHEN doc % 3 = 0 OR doc % 4 = 1 THEN 'Sim' ELSE 'Não' END AS has, CASE WHEN doc % 3 = 0 THEN 'PA' || (doc % 5) ELSE '' END AS guideline_ids FROM l LEFT JOIN n USING (doc, kind, value)""")
def report_guideline_entities(spark, sf_dir):
    """Entities with guideline information."""
    i = _items(spark, sf_dir)
    ids = F.when(F.col("doc") % 3 == 0, F.array(F.concat(F.lit("PA"), (F.col("doc") % 5).cast("string")), F.lit(" ")))
    listed = i.filter("section = 'O'").select("doc", "kind", "value").distinct().select("doc", (F.col("doc") % 10).cast("string").alias("substance"), "kind", "value", ids.alias("guideline_ids"), F.when(F.col("doc") % 4 == 1, True).alias("flag"))
    return reports.guideline_entities_sheet(listed, i.filter("n > 10").select("doc", "kind", "value", "n"))
