"""Joins, arbitration, rules and segmentation over rows of the shared tables; the SQL side says from their meaning what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import entities as ent
from labelspark.functions import fidelity as fid
from labelspark.functions import sections as sec
from labelspark.functions import substances as sub
from labelspark.operators import agreement, analysis, dedup, filters, matching
from labelspark.plans.registry import query, read
from labelspark.sources import readers, sinks
from labelspark.sources.shared import materialize
from labelspark.streaming import incremental


def _parts(spark, sf_dir, **columns: str):
    """Columns made of part's rows."""
    return read(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


# ---- dictionaries


@query("""WITH g AS (SELECT p_partkey AS pos, upper(replace(p_name, ' ', '')) || p_size AS symbol, * FROM part),
    a AS (SELECT symbol AS alias, 0 AS r, pos, symbol FROM g UNION ALL SELECT upper(p_brand), 1, pos, symbol FROM g UNION ALL SELECT upper(p_type), 1, pos, symbol FROM g UNION ALL SELECT upper(p_name), 2, pos, symbol FROM g),
    best AS (SELECT alias, symbol FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY r, pos, symbol) = 1),
    t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) || '*' || p_size WHEN 1 THEN ' ' || p_type WHEN 2 THEN p_name ELSE p_name || 'x' END AS term FROM part)
    SELECT id, term, symbol FROM t LEFT JOIN best ON upper(trim(split_part(term, '*', 1))) = alias""")
def genes_of_terms(spark, sf_dir):
    """Terms to official symbols: symbols before alternates before names, then file order."""
    genes = _parts(spark, sf_dir, pos="p_partkey", symbol="concat(upper(replace(p_name, ' ', '')), p_size)", alternates="concat(p_brand, ', ', p_type)", name="p_name")
    terms = _parts(spark, sf_dir, id="p_partkey", term="CASE p_partkey % 4 WHEN 0 THEN concat(lower(p_brand), '*', p_size) WHEN 1 THEN concat(' ', p_type) WHEN 2 THEN p_name ELSE concat(p_name, 'x') END")
    return matching.resolve_genes(terms, "term", genes).select("id", "term", "symbol")


@query("""WITH d AS (SELECT upper(p_name) AS k, arg_max(p_type, p_partkey) AS name, arg_max('H' || p_size, p_partkey) AS hgnc_id FROM part GROUP BY 1), s AS (SELECT DISTINCT lower(p_name) AS symbol FROM part UNION ALL SELECT n_name FROM nation)
    SELECT symbol, name, hgnc_id FROM s LEFT JOIN d ON upper(symbol) = k""")
def enriched_symbols(spark, sf_dir):
    """The dictionary's last row of each symbol, whatever its case; a symbol that it lacks stays bare."""
    genes = _parts(spark, sf_dir, pos="p_partkey", symbol="if(p_partkey % 2 = 0, upper(p_name), p_name)", alternates="p_brand", name="p_type", hgnc_id="concat('H', p_size)")
    symbols = _parts(spark, sf_dir, symbol="lower(p_name)").distinct().unionByName(read(spark, sf_dir, "nation").selectExpr("n_name AS symbol"))
    return matching.enrich_genes(symbols, genes)


@query("""SELECT upper(p_name) AS k, arg_max(p_brand, p_partkey) AS name FROM part GROUP BY 1""")
def last_rows_of_symbols(spark, sf_dir):
    genes = _parts(spark, sf_dir, pos="p_partkey", symbol="if(p_size % 2 = 0, concat(' ', upper(p_name)), p_name)", name="p_brand")
    return readers.last_by_symbol(genes).select(F.upper(F.trim("symbol")).alias("k"), "name")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '([A-Za-z]{6,})', 1)"


@query("""WITH known AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM benchmark), said AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{6,}')) AS gene FROM documents)
    SELECT gene, count(*) AS n_docs, list_sort(list(doc_id)) AS docs FROM said WHERE upper(gene) NOT IN (SELECT w FROM known) GROUP BY gene""")
def words_without_entry(spark, sf_dir):
    """Words of the documents that a dictionary of the benchmark's words lacks, with their documents."""
    said = read(spark, sf_dir, "documents").selectExpr("doc_id AS doc", f"explode(array_distinct({_WORDS})) AS gene")
    known = read(spark, sf_dir, "benchmark").selectExpr("item_id AS pos", f"explode(array_distinct({_WORDS})) AS symbol").withColumns({"alternates": F.lit(""), "name": F.lit("")})
    return matching.genes_without_ids(said, known)


# ---- variants

_ASKED_SQL = "asked AS (SELECT s_suppkey AS id, 'Brand#' || (s_suppkey % 30) AS variant, CASE s_suppkey % 3 WHEN 0 THEN [] WHEN 1 THEN [['ring', 'hot widget', 'gea'][s_suppkey % 7 % 3 + 1], ''] ELSE ['very red plate', 'old'] END AS queries FROM supplier)"
_FITS_SQL = "(CASE WHEN id % 3 = 0 THEN TRUE ELSE len(list_filter(queries, lambda q: q <> '' AND (contains(' ' || p_name || ' ', ' ' || q || ' ') OR contains(' ' || q || ' ', ' ' || p_name || ' ')))) > 0 END)"


def _asked(spark, sf_dir, key: str):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", f"concat('{key}#', s_suppkey % 30) AS variant", "CASE s_suppkey % 3 WHEN 0 THEN array() WHEN 1 THEN array(element_at(array('Ring', 'hot widget', 'gea'), cast(s_suppkey % 7 % 3 + 1 as int)), ' ') ELSE array('Very red plate', 'OLD') END AS queries")


def _variants(spark, sf_dir):
    return _parts(spark, sf_dir, pos="p_partkey", variant="concat(p_brand, ', ', p_type, p_size, ',')", gene="p_brand", chemicals="concat(p_name, '; ')", level="cast(p_size as string)")


@query(f"WITH {_ASKED_SQL} SELECT id, p_partkey AS pos, p_size::VARCHAR AS level FROM asked JOIN part ON variant = p_brand WHERE {_FITS_SQL}")
def variants_of_suppliers(spark, sf_dir):
    """Records of a variant whose chemicals equal a query, hold it as whole words or are held by it; without queries, all."""
    return matching.variant_matches(_asked(spark, sf_dir, "brand"), matching.explode_variants(_variants(spark, sf_dir))).select("id", "pos", "level")


@query(f"WITH {_ASKED_SQL} SELECT id, min(p_partkey) AS pos, arg_min(p_size::VARCHAR, p_partkey) AS level FROM asked JOIN part ON variant = p_brand WHERE {_FITS_SQL} GROUP BY id")
def first_variants_of_suppliers(spark, sf_dir):
    return matching.best_variant(_asked(spark, sf_dir, "BRAND"), matching.explode_variants(_variants(spark, sf_dir))).select("id", "pos", "level")


@query(f"WITH {_ASKED_SQL} SELECT DISTINCT id, p_name, p_size::VARCHAR AS level FROM asked JOIN part ON variant = p_brand WHERE {_FITS_SQL}")
def records_of_genes(spark, sf_dir):
    """By gene: equal records of one question once, whatever their place in the file."""
    asked = _asked(spark, sf_dir, "brand").withColumnRenamed("variant", "gene")
    records = _variants(spark, sf_dir).drop("variant")
    return matching.variant_matches(asked, records, "gene").select("id", F.trim(F.regexp_replace("chemicals", ";", "")).alias("p_name"), "level")


@query(f"WITH {_ASKED_SQL} SELECT id, variant AS gene FROM asked WHERE EXISTS (SELECT 1 FROM part WHERE variant = p_brand AND {_FITS_SQL})")
def genes_with_evidence(spark, sf_dir):
    asked = _asked(spark, sf_dir, "Brand").withColumnRenamed("variant", "gene")
    return matching.with_variant_evidence(asked, _variants(spark, sf_dir)).select("id", "gene")


# ---- substances, guidelines, concepts

_SAME_SQL = "(v = q OR (length(least_) >= 4 AND contains(' ' || most_ || ' ', ' ' || least_ || ' ')))"


@query(f"""WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS substance, split_part(p_name, ' ', 2) AS q FROM part UNION SELECT 'extra ' || p_name, 'extra ' || p_name FROM part),
    g AS (SELECT DISTINCT 'PA' || p_partkey % 700 AS guideline_id, p_name AS v, 'chemicals' AS via FROM part WHERE p_partkey % 700 % 2 = 0 UNION SELECT 'PA' || p_partkey % 700, lower(p_type) || ' ' || p_name, 'text' FROM part WHERE p_partkey % 700 % 2 = 1),
    b AS (SELECT *, CASE WHEN length(q) <= length(v) THEN q ELSE v END AS least_, CASE WHEN length(q) <= length(v) THEN v ELSE q END AS most_ FROM s, g)
    SELECT DISTINCT substance, guideline_id, via FROM b WHERE {_SAME_SQL}""")
def guidelines_of_names(spark, sf_dir):
    """Guidelines by their chemicals, or by their other strings where they list none; whole words of at least four characters."""
    s = _parts(spark, sf_dir, substance="split_part(p_name, ' ', 2)").unionByName(_parts(spark, sf_dir, substance="concat('extra ', p_name)")).distinct().withColumn("query", F.col("substance"))
    g = _parts(spark, sf_dir, id="p_partkey % 700", name="p_name", type="p_type").groupBy("id").agg(F.collect_set("name").alias("names"), F.collect_set(F.concat_ws(" ", "type", "name")).alias("others"))
    g = g.select(F.concat(F.lit("PA"), F.col("id").cast("string")).alias("guideline_id"), F.when(F.col("id") % 2 == 0, F.col("names")).alias("chemicals"), F.col("others").alias("strings"))
    return matching.resolve_guidelines(s, g)


@query("""WITH e AS (SELECT DISTINCT split_part(text, '.', 1) AS entity, ['en', 'fr', 'zz'][item_id % 3 + 1] AS gene FROM benchmark),
    inside AS (SELECT DISTINCT entity, doc_id FROM e, documents WHERE trim(entity) <> '' AND contains(lower(text), lower(trim(entity)))),
    by_gene AS (SELECT entity, doc_id FROM e JOIN documents ON gene = lang WHERE entity NOT IN (SELECT entity FROM inside))
    SELECT entity, doc_id AS guideline_id FROM inside UNION SELECT * FROM by_gene""")
def passages_named_in_documents(spark, sf_dir):
    """An entity inside a guideline's text; only where none holds it, guidelines of its gene."""
    e = read(spark, sf_dir, "benchmark").selectExpr("split_part(text, '.', 1) AS entity", "element_at(array('en', 'fr', 'zz'), cast(item_id % 3 + 1 as int)) AS gene").distinct()
    return matching.guideline_entities(e, read(spark, sf_dir, "documents").selectExpr("doc_id AS guideline_id", "array(lang) AS genes", "array(text) AS strings"))


_CONCEPTS_SQL = """c AS (SELECT p_partkey AS pos, 'C' || p_partkey % 200 AS cui, p_name || CASE WHEN p_size > 25 THEN ' ' || lower(p_type) ELSE '' END AS str, CASE WHEN p_size % 3 = 0 THEN 'POR' ELSE 'ENG' END AS lat,
        CASE WHEN p_partkey % 5 = 0 THEN coalesce(nullif(trim(CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'D' || p_size END), ''), p_brand) END AS vendor FROM part),
    q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_name || ' promo extra' FROM part),
    x AS (SELECT query, cui, str, TRUE AS exact, pos FROM q JOIN c ON query = str),
    m AS (SELECT * FROM x UNION SELECT query, cui, str, FALSE, pos FROM q, c WHERE query NOT IN (SELECT query FROM x) AND length(query) >= 5 AND length(str) >= 5 AND (contains(query, str) OR contains(str, query))),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY exact DESC, pos, cui) <= 25)"""


def _concepts(spark, sf_dir):
    return _parts(
        spark, sf_dir, pos="p_partkey", cui="concat('C', p_partkey % 200)", str="concat(initcap(p_name), if(p_size > 25, concat(' ', lower(p_type)), ''))", lat="if(p_size % 3 = 0, 'POR', 'ENG')",
        scui="p_brand", sab="if(p_partkey % 5 = 0, 'DrugBank', 'X')", code="if(p_size % 7 = 0, ' ', concat('D', p_size))",
    )


def _concept_queries(spark, sf_dir):
    each = [_parts(spark, sf_dir, query=q) for q in ("split_part(p_name, ' ', 2)", "p_name", "concat(p_name, ' promo extra')")]
    return each[0].unionByName(each[1]).unionByName(each[2]).distinct()


@query(f"WITH {_CONCEPTS_SQL} SELECT query, cui, exact, pos FROM f")
def concepts_of_names(spark, sf_dir):
    """Equal names, else names that hold the query or lie inside it, the first 25 in file order."""
    return matching.concept_candidates(_concept_queries(spark, sf_dir), _concepts(spark, sf_dir)).select("query", "cui", "exact", "pos")


@query(f"""WITH {_CONCEPTS_SQL}, v AS (SELECT cui, arg_max(vendor, pos) AS vendor_id FROM c WHERE vendor IS NOT NULL GROUP BY cui),
    t AS (SELECT cui, list(str ORDER BY length(str), str)[1:12] AS english FROM (SELECT DISTINCT cui, str FROM c WHERE lat = 'ENG') GROUP BY cui)
    SELECT query, f.cui, exact, vendor_id, list_transform(coalesce(english, []), lambda s: lower(s)) AS english, row_number() OVER (PARTITION BY query ORDER BY vendor_id IS NULL, exact DESC, str, f.cui) AS place FROM f LEFT JOIN v ON f.cui = v.cui LEFT JOIN t ON f.cui = t.cui""")
def concept_rows_of_names(spark, sf_dir):
    """Concepts with the vendor's id and their shortest English terms, those with an id first."""
    k = _concepts(spark, sf_dir)
    out = matching.concept_details(matching.concept_candidates(_concept_queries(spark, sf_dir), k), k)
    return out.select("query", "cui", "exact", "vendor_id", F.transform(F.coalesce("english", F.array().cast("array<string>")), F.lower).alias("english"), F.col("place").cast("long").alias("place"))


@query("""SELECT l_orderkey AS doc, l_linenumber AS query_pos, l_quantity AS place, l_returnflag = 'A' AS exact FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A') DESC, l_linenumber, l_quantity) = 1""")
def first_matches_of_orders(spark, sf_dir):
    """Of an order's matches the exact before the partial, then the queries' order, then the place."""
    found = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS query_pos", "l_quantity AS place", "l_returnflag = 'A' AS exact")
    return matching.arbitrate(found)


@query("""WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
    SELECT p_partkey AS doc, [p_name, b] || CASE WHEN p_size % 2 = 0 THEN (CASE WHEN lower(a) = lower(p_type) THEN [p_type] ELSE [p_type, a] END) || CASE WHEN p_size % 4 = 0 THEN ['other ' || b] ELSE [] END ELSE [] END AS queries FROM p""")
def synonyms_of_parts(spark, sf_dir):
    """English terms of exact matches are added unless they are there, hold a digit or have more than two words."""
    q = _parts(spark, sf_dir, doc="p_partkey", queries="array(p_name, split_part(p_name, ' ', 2))")
    one = _parts(spark, sf_dir, doc="p_partkey", exact="p_size % 2 = 0", place="1", english="array(p_brand, p_type, upper(p_name), concat('one ', p_name))")
    two = _parts(spark, sf_dir, doc="p_partkey", exact="p_size % 2 = 0", place="2", english="array(split_part(p_name, ' ', 1), lower(p_type), if(p_size % 4 = 0, concat('other ', split_part(p_name, ' ', 2)), p_name))")
    return matching.add_synonyms(q, one.unionByName(two))


_COMPOUNDS_SQL = """k AS (SELECT DISTINCT p_type AS compound, lower(p_type) AS inn, NULL AS pt FROM part UNION SELECT DISTINCT p_name, '', p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_name, split_part(p_name, ' ', 2) FROM part),
    r AS (SELECT p_partkey AS file, p_name || ' 5 mg' AS name, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN lower(p_type) ELSE 'a ' || p_name END AS label FROM part),
    h AS (SELECT file, compound, CASE WHEN inn <> '' AND contains(' ' || label || ' ', ' ' || inn || ' ') THEN 'inn' WHEN pt <> '' AND contains(' ' || name || ' ', ' ' || pt || ' ') THEN 'pt' END AS route FROM r, k),
    hits AS (SELECT file, compound, min(route) AS route FROM h WHERE route IS NOT NULL GROUP BY file, compound)"""


def _compound_hits(spark, sf_dir):
    register = _parts(spark, sf_dir, file="p_partkey", name="concat(p_name, ' 5 mg')", atc_label="CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE concat('A ', replace(p_name, ' ', '-')) END")
    each = (("p_type", "lower(p_type)", "cast(NULL as string)"), ("p_name", "' '", "replace(p_name, ' ', '-')"), ("split_part(p_name, ' ', 2)", "p_name", "split_part(p_name, ' ', 2)"))
    made = [_parts(spark, sf_dir, compound=a, inn=b, pt=c).distinct() for a, b, c in each]
    return matching.select_compounds(register, made[0].unionByName(made[1]).unionByName(made[2]))


@query(f"WITH {_COMPOUNDS_SQL} SELECT file, compound, route FROM hits")
def compounds_of_parts(spark, sf_dir):
    """Compounds named by the group label, else by the name; hyphens and blanks of a name are the same."""
    return _compound_hits(spark, sf_dir)


@query(f"WITH {_COMPOUNDS_SQL}, known AS (SELECT p_partkey AS file, p_brand AS compound FROM part WHERE p_size < 10) SELECT * FROM known UNION ALL (SELECT file, compound FROM hits WHERE file NOT IN (SELECT file FROM known) QUALIFY row_number() OVER (PARTITION BY file ORDER BY length(compound) DESC, compound) = 1)")
def compound_of_each_part(spark, sf_dir):
    """A file's compound: as known, else the longest name found."""
    return matching.assign_compound(_compound_hits(spark, sf_dir), read(spark, sf_dir, "part").filter("p_size < 10").selectExpr("p_partkey AS file", "p_brand AS compound"))


@query("SELECT p_partkey, [p_name || ' + ' || p_type, p_name, p_type] AS parts FROM part")
def combinations_split(spark, sf_dir):
    """A combination first whole, then its parts."""
    return read(spark, sf_dir, "part").select("p_partkey", sub.split_substances(F.concat("p_name", F.lit(" + "), "p_type")).alias("parts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_name, p_type || ' / ' || p_name, p_type] ELSE [p_type || ' / ' || p_name, p_type, p_name] END AS queries FROM part""")
def queries_of_parts(spark, sf_dir):
    """Aliases' parts before the name's; a folded form that is there already is left out."""
    aliases = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.upper("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", sub.build_queries(F.concat("p_type", F.lit(" / "), "p_name"), aliases).alias("queries"))


@query(f"""WITH q AS (SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_name WHEN 2 THEN 'new ' || p_name ELSE substr(p_name, 1, 5) END AS query FROM part),
    b AS (SELECT p_name AS value, query, p_name AS v, trim(query) AS q FROM part JOIN q USING (p_size)), o AS (SELECT *, CASE WHEN length(q) <= length(v) THEN q ELSE v END AS least_, CASE WHEN length(q) <= length(v) THEN v ELSE q END AS most_ FROM b)
    SELECT value, query, {_SAME_SQL} AS same, count(*) AS n FROM o GROUP BY ALL""")
def names_of_one_size(spark, sf_dir):
    """Whether two names of one size are the same substance."""
    p = read(spark, sf_dir, "part").groupBy("p_size", F.col("p_name").alias("value")).agg(F.count("*").alias("n"))
    q = _parts(spark, sf_dir, p_size="p_size", query="CASE p_size % 4 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_name WHEN 2 THEN concat('new ', p_name) ELSE substr(p_name, 1, 5) END").distinct()
    pairs = p.join(q, "p_size").groupBy("value", "query").agg(F.sum("n").alias("n"))
    return pairs.select("value", "query", sub.matches(F.col("value"), F.col("query")).alias("same"), "n")


# ---- representatives, notes, fallbacks, stages


@query("""SELECT p_brand || p_size AS hash, arg_min(p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, p_name, p_partkey)) AS file FROM part GROUP BY 1""")
def representatives_of_parts(spark, sf_dir):
    """No generic maker if possible, then name, then file."""
    return dedup.representatives(_parts(spark, sf_dir, hash="concat(p_brand, p_size)", file="p_partkey", name="upper(p_name)", maker="CASE p_partkey % 3 WHEN 0 THEN 'Teva Pharma' WHEN 1 THEN p_brand END")).select("hash", "file")


@query("SELECT p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 1 WHEN count(*) OVER w > 1 THEN min(p_partkey) OVER w END AS representative FROM part WINDOW w AS (PARTITION BY p_name, p_size, p_type)")
def map_rebuilt_of_parts(spark, sf_dir):
    d = _parts(spark, sf_dir, doc="p_partkey", hash="concat_ws('|', p_name, p_size, p_type)")
    return dedup.rebuilt_map(d, read(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey AS doc", "p_partkey - 1 AS representative"), "doc", "hash")


@query("SELECT c_nationkey AS k, c_mktsegment AS s, arg_min(c_name, (c_acctbal, c_custkey)) AS name FROM customer GROUP BY 1, 2")
def first_rows_of_customers(spark, sf_dir):
    d = read(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "c_mktsegment AS s", "c_name AS name", "c_acctbal", "c_custkey")
    return dedup.ordered_distinct(d, ["k", "s"], ["c_acctbal", "c_custkey"]).select("k", "s", "name")


@query("""SELECT p_size AS doc, arg_min(o, p_partkey) AS original, arg_min(p_brand, p_partkey) AS normalized, p_type AS type, sum(greatest(p_partkey % 4, 1)) AS n FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS o FROM part) WHERE p_partkey % 10 <> 0 GROUP BY p_size, lower(o), upper(p_brand), p_type""")
def notes_merged_of_parts(spark, sf_dir):
    """Notes that differ only in case are one, the first spelling kept; blank ones are none."""
    notes = _parts(spark, sf_dir, doc="p_size", original="if(p_partkey % 10 = 0, ' ', concat(if(p_partkey % 2 = 0, upper(p_name), p_name), ' '))", normalized="p_brand", type="p_type", n="cast(p_partkey % 4 as int)", pos="p_partkey")
    return analysis.merged_notes(notes).select("doc", "original", "normalized", "type", "n")


@query("""SELECT doc_id AS doc, 'seccao' AS source, source AS original, n_chars % 5 AS n FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'documento', lang, n_chars % 7 FROM documents WHERE n_chars % 2 = 0
    UNION ALL SELECT doc_id, 'agregado', '(sem detalhe)', n_chars % 3 FROM documents WHERE n_chars % 3 > 0 AND lang <> 'en' AND n_chars % 2 <> 0""")
def notes_of_documents(spark, sf_dir):
    """Notes of sections and of documents, and one row for documents that count some but list none."""
    d = read(spark, sf_dir, "documents")
    a = d.filter("lang = 'en'").selectExpr("doc_id AS doc", "source AS original", "upper(source) AS normalized", "'gene' AS type", "cast(n_chars % 5 as long) AS n")
    b = d.filter("n_chars % 2 = 0").selectExpr("doc_id AS doc", "lang AS original", "upper(lang) AS normalized", "'gene' AS type", "cast(n_chars % 7 as long) AS n")
    return analysis.normalisation_rows(a, b, d.selectExpr("doc_id AS doc", "cast(n_chars % 3 as long) AS n")).select("doc", "source", "original", "n")


@query("""WITH g AS (SELECT DISTINCT p_brand AS doc, p_name AS v FROM part WHERE p_size % 2 = 0), f AS (SELECT DISTINCT p_brand AS doc, p_name AS v FROM part WHERE p_size % 3 = 0)
    SELECT (SELECT count(*) FROM g) AS expected, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM f)) AS "right", (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) AS missed, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM g)) AS invented""")
def names_expected_and_found(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("p_brand AS doc", "p_name AS v", "p_size")
    return agreement.confusion(p.filter("p_size % 2 = 0"), p.filter("p_size % 3 = 0"), ["doc", "v"])


@query("""SELECT s AS status, CASE s WHEN 'scanned' THEN 'Digitalizado, sem texto' WHEN 'sem_estrutura' THEN 'Sem secções reconhecíveis' ELSE 'Outro' END AS cause, count(*) AS n
    FROM (SELECT CASE WHEN length(coalesce(text, '')) < 400 THEN 'scanned' WHEN NOT contains(text, chr(10)) THEN 'sem_estrutura' WHEN lang = 'fr' THEN 'pendente' END AS s FROM documents) WHERE s IS NOT NULL GROUP BY 1, 2""")
def causes_of_documents(spark, sf_dir):
    """Documents by the first stage that stops them, and unusable ones by cause."""
    text = F.coalesce("text", F.lit(""))
    stages = [("scanned", F.length(text) < 400), ("sem_estrutura", ~text.contains("\n")), ("pendente", F.col("lang") == "fr")]
    return analysis.unusable_rows(incremental.staged(read(spark, sf_dir, "documents"), stages).withColumn("status", F.when(F.col("status") == "ok", "digital").otherwise(F.col("status"))))


@query("""WITH w AS (SELECT DISTINCT p_name || ' ' || p_size AS compound, p_size, p_name FROM part), u AS (SELECT p_name || ' ' || p_size AS c, bool_or(p_partkey % 4 = 0) AS good FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), l AS (SELECT DISTINCT p_name || ' ' || p_size AS c FROM part WHERE p_size < 20)
    SELECT compound, CASE WHEN u.c IS NOT NULL THEN 'ilegivel' WHEN l.c IS NOT NULL THEN 'listado sem RCM' ELSE 'fora do corpus' END AS reason FROM w LEFT JOIN u ON compound = u.c LEFT JOIN l ON compound = l.c WHERE NOT coalesce(good, FALSE)""")
def reasons_of_names(spark, sf_dir):
    """Why a compound has no label; one good document is enough to have one."""
    p = read(spark, sf_dir, "part").withColumn("compound", F.concat_ws(" ", "p_name", "p_size"))
    usable = p.filter("p_partkey % 2 = 0").selectExpr("compound", "p_partkey % 4 = 0 AS usable")
    return analysis.not_found(p.select("compound").distinct(), p.filter("p_size < 20").select("compound"), usable, "compound")


@query("""WITH o AS (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id, -count(*) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.user_id = n.user_id""")
def users_upserted(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    by = lambda t, v: e.filter(F.col("event_type") == t).groupBy("user_id").agg(v.alias("v"))
    return incremental.upsert(by("click", F.count("*")), by("purchase", -F.count("*")), "user_id")


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN source ELSE upper(lang) END AS guidelines, 2 AS rules_version FROM documents")
def rules_refreshed(spark, sf_dir):
    """Only rows of another or no version of the rules are computed anew."""
    cache = read(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "source AS guidelines", "nullif(cast(n_chars % 3 as int), 0) AS rules_version")
    return incremental.refresh(cache, 2, lambda df: df.withColumn("guidelines", F.upper("lang"))).drop("lang")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digests_once(spark, sf_dir):
    return incremental.once_each(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "digest", F.sha2("text", 256)).select("doc_id", "digest")


@query("SELECT l_orderkey AS doc, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END) AS file, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def first_files_of_orders(spark, sf_dir):
    """Of each order the file that comes first in a list of names, beside how many files it has."""
    p = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_returnflag AS file", "cast(l_linenumber as string) AS path")
    n = p.filter("file IN ('R', 'A')").groupBy("doc").agg(F.count("*").alias("n"))
    return readers.first_existing(p, ["R", "A"]).join(n, "doc").select("doc", "file", "n")


@query("SELECT doc_id AS doc, CASE WHEN lang = 'en' THEN sha256(text) WHEN n_chars % 2 = 0 THEN source END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def texts_of_usable_documents(spark, sf_dir):
    """Converted text, else extracted, of documents without a marker."""
    d = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc")
    marked = read(spark, sf_dir, "labels").filter("toxic = 1").selectExpr("doc_id AS doc")
    usable = readers.split_unusable(d.select("doc"), marked)[0]
    return readers.with_markdown(usable, d.filter("lang = 'en'").select("doc", F.sha2("text", 256).alias("text")), d.filter("n_chars % 2 = 0").selectExpr("doc", "source AS text"))


@query("SELECT event_id AS query, CASE WHEN event_id % 3 < 2 THEN 'D' || lpad((event_id % 1000000)::VARCHAR, 6, '0') END AS mesh_id FROM events")
def ids_in_answers(spark, sf_dir):
    """The id under the known key, else the first anywhere in the answer."""
    answers = read(spark, sf_dir, "events").selectExpr("event_id AS query", "CASE event_id % 3 WHEN 0 THEN concat('{\"x\": \"D999999\", \"ds_meshui\": \"D', lpad(event_id % 1000000, 6, '0'), '\"}') WHEN 1 THEN concat('{\"p\": ', props, ', \"see\": [\"D', lpad(event_id % 1000000, 6, '0'), '\", \"D000001\"]}') ELSE props END AS json")
    return readers.mesh_id(answers)


@query("""WITH f AS (SELECT c_name AS de, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_mktsegment || '/' || floor(c_acctbal / 10)::INT END AS para FROM customer) SELECT de, para, 'arrumar' AS motivo FROM f WHERE de <> para AND para NOT IN (SELECT para FROM f WHERE de <> para GROUP BY para HAVING count(*) > 1)""")
def moves_of_customers(spark, sf_dir):
    """Moves that change something, without those whose target two files want."""
    f = read(spark, sf_dir, "customer").selectExpr("c_name AS path", "if(c_custkey % 5 = 0, c_name, concat(c_mktsegment, '/', cast(floor(c_acctbal / 10) as int))) AS target")
    return sinks.moves(f, F.col("target"), F.lit("arrumar"))


# ---- predicates and JSON of rows


@query("""SELECT p_partkey, list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'pasta em falta' END, CASE WHEN p_size % 5 = 0 THEN 'sem seccoes' END, CASE WHEN p_partkey % 3 <> 0 THEN 'saida em falta' END, CASE WHEN p_partkey % 11 = 0 THEN 'sem substancia ativa' END, CASE WHEN p_size % 5 <> 0 AND p_size % 9 NOT IN (2, 4) THEN 'sem seccoes nucleares' END], lambda x: x IS NOT NULL) AS problems FROM part""")
def problems_of_parts(spark, sf_dir):
    p = _parts(spark, sf_dir, p_partkey="p_partkey", folder="if(p_partkey % 7 = 0, ' ', p_name)", sections="if(p_size % 5 = 0, NULL, array(concat('4.', p_size % 9), '6.1'))", output="CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", substance="if(p_partkey % 11 = 0, NULL, p_type)")
    return p.select("p_partkey", filters.problems(F.col("folder"), F.col("sections"), F.col("output"), F.col("substance")).alias("problems"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (pgx) AS n_pgx, count(*) FILTER (guided) AS n_guided FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN l_quantity > 25 ELSE CASE WHEN l_linestatus = 'F' THEN l_discount > 0.05 ELSE l_tax > 0.04 OR l_linenumber > 3 END END AS pgx, l_linenumber > 4 OR l_tax > 0.06 OR l_discount > 0.08 AS guided FROM lineitem) GROUP BY 1""")
def evidence_of_lines(spark, sf_dir):
    """The first flag that is there decides; ids, a flag or a source are a guideline."""
    li = read(spark, sf_dir, "lineitem").withColumns({
        "pgx": filters.has_pgx(F.when(F.col("l_returnflag") == "A", F.col("l_quantity") > 25), F.when(F.col("l_linestatus") == "F", F.col("l_discount") > 0.05), F.col("l_tax") > 0.04, F.col("l_linenumber") > 3),
        "guided": filters.has_guideline(F.when(F.col("l_linenumber") > 4, F.array("l_returnflag")).otherwise(F.array(F.lit(" "))), F.when(F.col("l_tax") > 0.06, F.lit(True)), F.col("l_discount") > 0.08),
    })
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.count_if("pgx").alias("n_pgx"), F.count_if("guided").alias("n_guided"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR END AS nome_medicamento, CASE WHEN event_id % 3 < 2 THEN 'C' || (event_id % 3) || user_id END AS mrconso_cui FROM events""")
def fields_of_events(spark, sf_dir):
    """Fields of results in the new layout, in the old one, and in neither."""
    raw = F.expr("""CASE event_id % 3
        WHEN 0 THEN to_json(named_struct('documento', named_struct('nome_medicamento', event_type), 'nome_medicamento', 'old', 'identificadores_substancia', named_struct('mrconso_cui', concat('C0', user_id)), 'mrconso_cui', 'x'))
        WHEN 1 THEN to_json(named_struct('documento', named_struct('nome_medicamento', ' '), 'nome_medicamento', user_id, 'mrconso_cui', concat('C1', user_id))) ELSE props END""")
    return read(spark, sf_dir, "events").withColumn("raw", raw).select("event_id", *filters.document_fields(F.col("raw"))).select("event_id", "nome_medicamento", "mrconso_cui")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END::BIGINT AS n_strings FROM events")
def answers_salvaged(spark, sf_dir):
    """JSON of an answer: alone, in a fence, behind words and before another, broken; and how many strings it holds."""
    cut = "substr(props, 1, length(props) - 1)"
    raw = F.expr(f"""CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Resposta:\\n```json\\n', props, '\\n```\\nfim') WHEN 2 THEN concat('isto ', {cut}, ', "t": "}}{{"}} e {{"k": 0}}') ELSE {cut} END""")
    e = read(spark, sf_dir, "events").withColumn("json", fid.salvaged_json(raw))
    return e.select("event_id", F.get_json_object("json", "$.k").alias("k"), F.size(fid.json_strings("json")).cast("long").alias("n_strings"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, FALSE AS paths FROM events")
def answers_without_paths(spark, sf_dir):
    """Keys that end in path go at every depth."""
    raw = F.expr("""concat('{"file_path": "x", "in": [{"PATH": 1, "k": ', get_json_object(props, '$.k'), '}], "a": ', props, '}')""")
    e = read(spark, sf_dir, "events").withColumn("json", fid.without_paths(raw))
    return e.select("event_id", F.get_json_object("json", "$.in[0].k").alias("k"), F.lower("json").contains("path").alias("paths"))


@query("""SELECT p_partkey AS doc, 'star_alleles' AS kind, v AS value, n::INT AS mentions, contains(v, '*') AND v NOT LIKE '*%' AS complete FROM (
    SELECT p_partkey, p_brand || '*' || p_size AS v, greatest(p_partkey % 5 - 1, 1) AS n FROM part UNION ALL SELECT p_partkey, '*' || p_size, 1 FROM part UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_size % 2 = 0)""")
def items_of_parts(spark, sf_dir):
    """Items of a model's answer, each a string or an object; at least one mention each, blank ones left out."""
    j = "to_json(named_struct('star_alleles', array(to_json(named_struct('entity', ' ', 'variant', concat(p_brand, '*', p_size), 'total_mentions', p_partkey % 5 - 1)), concat('*', p_size), if(p_size % 2 = 0, concat(p_name, ' '), ' '))))"
    return fid.model_items(_parts(spark, sf_dir, doc="p_partkey", j=j), "doc", "j", "star_alleles").select("doc", "kind", "value", "mentions", "complete")


# ---- texts: segmentation, fidelity, counts

_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_LINES_SQL}, s AS (SELECT *, pos // 4 AS k FROM l), t AS (SELECT doc_id, k, ['4.2', '4.3', '6.1', '4.4', '5.1'][k % 5 + 1] AS numero, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos % 4 > 0), ''), ' ') AS content FROM s GROUP BY doc_id, k)
    SELECT doc_id, numero, 'Titulo ' || k || ' (a)' AS titulo, length(content) AS n_chars, sha256(content) AS digest FROM t WHERE numero <> '6.1' AND k < 5""")
def sections_of_documents(spark, sf_dir):
    """Every fourth line is a heading as PDFs print them; sections that count, the first of a number, with their lines."""
    t = sec.lines(read(spark, sf_dir, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    k = F.floor(F.col("pos") / 4)
    number = F.element_at(F.array(*[F.lit(x) for x in ("## 4 . 2.", "4.3", "6.1", "• 4.4", "5 .1")]), (k % 5 + 1).cast("int"))
    made = sec.heading(F.concat(number, F.lit(" Titulo "), k.cast("string"), F.lit(" (a)")))
    t = t.withColumn("line", F.when(F.col("pos") % 4 == 0, made).otherwise(F.col("line")))
    return sec.sections(sec.renumbered(t, "doc_id"), "doc_id").select("doc_id", "numero", "titulo", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query("""SELECT doc_id, split_part(text, chr(10), 1) = '' AS bare, sha256(text || chr(10)) AS digest FROM documents""")
def chapters_of_documents(spark, sf_dir):
    """A document's text as the second of three chapters."""
    d = read(spark, sf_dir, "documents")
    md = F.concat(F.lit("# 1. Nome\nx\n# 2. Texto\n"), "text", F.lit("\n# 3. Fim\ny"))
    return d.select("doc_id", F.startswith(sec.top_section(md, 2), F.lit("\n")).alias("bare"), F.sha2(sec.top_section(md, 2), 256).alias("digest"))


@query("""SELECT p_partkey, p_size || '.' || p_partkey % 9 || ' ' || p_name || '. ' || p_type AS label, p_size || '.' || p_partkey % 9 AS code, 'N' || lpad((p_size % 100)::VARCHAR, 2, '0') || 'BE01' AS atc FROM part""")
def group_labels_of_parts(spark, sf_dir):
    """Group label, its number and the printed code behind it, with blanks and line ends as PDFs leave them."""
    md = F.expr("concat('5.1 Propriedades\nGrupo farmacoterapêutico: ', p_size, ' . ', p_partkey % 9, ' ', replace(p_name, ' ', '\n'), if(p_partkey % 2 = 0, ' .\n', '. '), p_type, if(p_partkey % 3 = 0, '.\n', ';'), '\nCódigo ATC: n', lpad(p_size % 100, 2, '0'), 'be01\n')")
    g = sec.group_label(md)
    return read(spark, sf_dir, "part").select("p_partkey", g["label"].alias("label"), g["code"].alias("code"), sec.atc_in_text(md).alias("atc"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['tabela_' || p_size || '|Tabela ' || p_size || ': ' || p_type || chr(10) || p_name] ELSE [] END || ['tabela_?|Tabela ?' || chr(10) || p_brand] AS units FROM part""")
def table_units_of_parts(spark, sf_dir):
    t = F.expr("array(named_struct('numero', cast(p_size as string), 'titulo', concat(p_type, ' '), 'texto', if(p_size % 3 = 0, concat(' ', p_name), ' ')), named_struct('numero', cast(NULL as string), 'titulo', ' ', 'texto', p_brand))")
    return read(spark, sf_dir, "part").select("p_partkey", F.transform(sec.table_units(t), lambda x: F.concat(x["origem"], F.lit("|"), x["texto"])).alias("units"))


@query("""SELECT doc_id, trim(replace(split_part(text, chr(10), 1), '-', '')) <> '' AS verbatim FROM documents""")
def first_lines_verbatim(spark, sf_dir):
    """A document's first line is in its text, whatever case, blanks and line breaks did to it; an empty one is nowhere."""
    d = read(spark, sf_dir, "documents")
    line = F.translate(F.split("text", "\n")[0], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return d.select("doc_id", (fid.fidelity(F.regexp_replace(line, " ", "  \n"), "text") == "verbatim").alias("verbatim"))


_PLAIN_SQL = r"trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]', ' ', 'g')), '[ \n]+', ' ', 'g'))"
_PAIRS_SQL = rf"""t AS (SELECT doc_id, {_PLAIN_SQL} AS block, unnest(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]', ' ', 'g'), chr(10))) AS line FROM documents),
    e AS (SELECT doc_id AS unit, doc_id AS origin, line FROM t UNION ALL SELECT doc_id - doc_id % 5, doc_id, line FROM t WHERE doc_id % 5 > 0),
    v AS (SELECT unit, origin, trim(regexp_replace(lower(line), ' +', ' ', 'g')) AS line, {_PLAIN_SQL} AS block FROM e JOIN documents ON doc_id = unit)"""


def _lines_against_texts(spark, sf_dir):
    """Each line of a document as an excerpt of it, and of the first of its five."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9\n]", " ").alias("texto"))
    d = materialize(d)  # cleaned once for the texts, their lines and the lines' number
    lines = d.select(F.col("doc_id").alias("origin"), F.posexplode(F.split("texto", "\n")).alias("pos", "texto_original"))
    home = F.col("origin") - F.col("origin") % 5
    e = lines.withColumn("unit", F.explode(F.when(F.col("origin") == home, F.array("origin")).otherwise(F.array("origin", home))))
    return d.withColumnRenamed("doc_id", "unit"), e


@query(f"""WITH {_PAIRS_SQL} SELECT unit, count(*) AS n_excerpts, count_if(line <> '' AND contains(block, line))::BIGINT AS n_verbatim, count_if(line = '')::BIGINT AS n_blank FROM v GROUP BY unit""")
def graded_lines(spark, sf_dir):
    """How many lines of five documents each text repeats; a text is made comparable once for all of them."""
    units, e = _lines_against_texts(spark, sf_dir)
    blank = (F.trim("texto_original") == "") & (F.col("fidelidade") == "nao_encontrado")
    return fid.graded(units, e, ["unit"]).groupBy("unit").agg(F.count("*").alias("n_excerpts"), F.count_if(F.col("fidelidade") == "verbatim").alias("n_verbatim"), F.count_if(blank).alias("n_blank"))


@query(f"""WITH {_PAIRS_SQL} SELECT unit, sum(CASE WHEN line <> '' AND contains(block, line) THEN 1 ELSE 0 END)::BIGINT AS n_verbatim, count(*) FILTER (NOT (line <> '' AND contains(block, line)))::BIGINT AS n_rest FROM v GROUP BY unit""")
def evaluated_documents(spark, sf_dir):
    """Documents as sections of one unit each, evaluated by the lines of five."""
    units, e = _lines_against_texts(spark, sf_dir)
    u = units.select(F.col("unit").cast("string").alias("section"), "unit", F.lit("content").alias("origem"), "texto")
    out = fid.evaluated(u, e.select(F.col("unit").cast("string").alias("section"), "unit", (F.col("origin") * 1_000_000 + F.col("pos")).alias("pos"), "texto_original"))
    return out.select(F.col("section").cast("long").alias("unit"), "n_verbatim", (F.col("n_recomposto") + F.col("n_nao_encontrado")).alias("n_rest"))


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])(the|THE|The)([^\p{L}\p{N}_]|$)') AS said FROM documents""")
def alleles_said(spark, sf_dir):
    """Whether an allele's spellings occur in texts that say one word as that allele."""
    text = F.regexp_replace("text", r"(?<![\p{L}\p{N}_])(the|THE|The)(?![\p{L}\p{N}_])", "cyp2d6 *4 , ")
    return read(spark, sf_dir, "documents").select("doc_id", (ent.allele_count(F.lit("CYP2D6*4"), text) > 0).alias("said"))


@query("SELECT page_id AS doc, page_id % 50 + 2 AS annex_page, page_id % 50 + 4 AS leaflet_page, 2::BIGINT AS n_starts FROM pages")
def annexes_of_pages(spark, sf_dir):
    """The first pages of annex II and of the leaflet among a document's pages, and how many summaries start."""
    p = read(spark, sf_dir, "pages").selectExpr("page_id AS doc", "page_id % 50 AS k", "html")
    each = F.array(*[F.struct(F.lit(n).alias("n"), t.alias("text")) for n, t in enumerate((F.lit("1. NOME DO MEDICAMENTO\nver ANEXO II"), F.concat(F.col("html"), F.lit(" ANEXO II")), F.concat(F.col("html"), F.lit("\n ANEXO II\n")), F.lit("NOME DO MEDICAMENTO\nANEXO II"), F.concat(F.lit("folheto informativo\n"), F.col("html"))))])
    rows = p.select("doc", "k", F.explode(each).alias("x")).select("doc", (F.col("k") + F.col("x.n")).alias("page"), F.col("x.text").alias("text"))
    return sec.annex_bounds(rows)


@query(f"""WITH {_LINES_SQL}, p AS (SELECT doc_id AS doc, pos + 1 AS page, line, pos % 6 = 1 AS opens, pos = 15 AS annex, pos % 9 = 8 AS leaflet FROM l),
    d AS (SELECT doc, max(page) AS pages, min(page) FILTER (annex) AS annex_page, bool_or(leaflet) AND bool_or(annex) AS whole_annex, 2 * count(*) FILTER (leaflet AND NOT annex AND NOT opens) AS n_titles FROM p GROUP BY doc),
    s AS (SELECT d.doc, p.page, substr(trim(regexp_replace(substr(line, 1, 199), '\\s+', ' ', 'g')), 1, 70) AS name, row_number() OVER (PARTITION BY d.doc ORDER BY p.page) AS k FROM d JOIN p ON d.doc = p.doc AND opens AND p.page <= coalesce(annex_page - 1, pages))
    SELECT d.doc, pages, annex_page, whole_annex, coalesce(annex_page - 1, pages) AS last_page, any_value(n_titles) AS n_titles, count(s.page) AS n_summaries, coalesce(max(s.page) FILTER (k = 2) - 1, annex_page - 1, pages) AS first_summary_end,
        coalesce(max(name) FILTER (k = 1), '') AS first_name, coalesce(max(name) FILTER (k = 2), '') AS second_name FROM d LEFT JOIN s ON d.doc = s.doc GROUP BY d.doc, pages, annex_page, whole_annex""")
def annex_outlines(spark, sf_dir):
    """Lines of documents as pages, some of which open summaries, annex II or a leaflet."""
    t = sec.lines(read(spark, sf_dir, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    text = F.when(F.col("pos") % 6 == 1, F.concat(F.lit("p.\n 1.  Nome do Medicamento\n"), "line", F.lit("\n2. COMPOSIÇÃO\nx"))).when(F.col("pos") == 15, F.concat("line", F.lit("\nANEXO II"))).when(F.col("pos") % 9 == 8, F.concat(F.lit("RESUMO DAS CARACTERÍSTICAS, resumo das caracteristicas "), "line", F.lit("\nv. folheto informativo"))).otherwise(F.concat(F.lit("ver ANEXO II "), "line"))
    return sec.annex_outline(t.select(F.col("doc_id").alias("doc"), (F.col("pos") + 1).alias("page"), text.alias("text")))
