"""Queries over documents, pages and labels: fingerprints, readability, duplicates, sections, lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.functions import sections as sec
from labelspark.functions import text as tx
from labelspark.functions.entities import bounded_count, counting_text
from labelspark.operators import agreement, dedup, filters, matching, mentions
from labelspark.plans.registry import query, read

_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+', ' ', 'g')))"


@query(f"""WITH d AS (SELECT doc_id, sha256({_NORM}) AS hash FROM documents)
    SELECT hash, min(doc_id) AS representative, count(*) AS n_docs FROM d GROUP BY hash""")
def text_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text"), ()).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n_docs"))


@query(r"""SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), '[%#$&*]{3,}', ' ', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')))) AS hash FROM documents""")
def volatile_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text"), (r"[%#$&*]{3,}", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+")).alias("hash"))


def _map(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text"), ()).alias("hash"))
    return dedup.duplicate_map(d, "hash", "doc_id", ["doc_id"])


_MAP_SQL = f"m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY hash) AS representative, hash FROM (SELECT doc_id, sha256({_NORM}) AS hash FROM documents))"


@query(f"WITH {_MAP_SQL} SELECT doc_id, representative, hash FROM m WHERE doc_id <> representative")
def dup_map(spark, sf_dir):
    return _map(spark, sf_dir)


@query(f"""WITH {_MAP_SQL}, d AS (SELECT * FROM m WHERE doc_id <> representative)
    SELECT doc_id, quality, toxic, NULL::BIGINT AS resultado_propagado_de FROM labels
    UNION ALL SELECT d.doc_id, l.quality, l.toxic, d.representative FROM d JOIN labels l ON l.doc_id = d.representative WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def propagated_rows(spark, sf_dir):
    return dedup.propagate(read(spark, sf_dir, "labels"), _map(spark, sf_dir), "doc_id")


@query(f"WITH {_MAP_SQL} SELECT doc_id, representative, hash FROM m WHERE doc_id <> representative AND representative NOT IN (SELECT doc_id FROM labels)")
def propagation_unresolved(spark, sf_dir):
    return dedup.unresolved(read(spark, sf_dir, "labels"), _map(spark, sf_dir), "doc_id").select("doc_id", "representative", "hash")


WORDS = ("the", "and", "of", "de", "la", "le", "der", "die", "und", "el")
_TOKENS = f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x IN ({', '.join(repr(w) for w in WORDS)})))"
_METRICS = rf"""m AS (SELECT doc_id, text, length(text) AS size,
    CASE WHEN length(text) > 0 THEN round({_TOKENS} / length(text)::DOUBLE * 1000, 2) ELSE 0 END AS word_density,
    CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text)::DOUBLE, 3) ELSE 0 END AS letter_fraction,
    CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) / length(text)::DOUBLE, 3) ELSE 0 END AS control_fraction FROM documents)"""


@query(f"WITH {_METRICS} SELECT doc_id, word_density, letter_fraction, control_fraction FROM m")
def readability_metrics(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in tx.readability(F.col("text"), WORDS).items()])


@query(rf"""WITH {_METRICS} SELECT CASE WHEN text IS NULL THEN 'unknown' WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 400 THEN 'scanned' WHEN control_fraction > 0.05 THEN 'corrupt'
    WHEN word_density < 3 THEN 'corrupt' WHEN letter_fraction < 0.35 THEN 'corrupt' ELSE 'digital' END AS status, count(*) AS n_docs FROM m GROUP BY 1""")
def usability_status(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(filters.usability(F.col("text"), None, WORDS).alias("status"))
    return d.groupBy("status").agg(F.count("*").alias("n_docs"))


@query(rf"""WITH composed AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7e]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents), {_METRICS.replace('FROM documents', 'FROM composed')}
    SELECT doc_id, coalesce(length(text) >= 400 AND word_density >= 3 AND letter_fraction >= 0.35, FALSE) AS readable FROM m""")
def preflight_documents(spark, sf_dir):
    """Texts whose characters a converter left in their wide forms are judged as the letters they are."""
    plain = F.regexp_replace("text", r"[^\x20-\x7e]", " ")
    ascii_ = "".join(map(chr, range(0x21, 0x7F)))
    wide = F.translate(plain, ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_))
    return read(spark, sf_dir, "documents").select("doc_id", filters.readable(wide, WORDS).alias("readable"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token""")
def accent_fold_tokens(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select(F.explode(F.split(tx.fold(F.col("text")), " ")).alias("token"))
    return t.filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')) AS folded FROM documents""")
def full_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.fold_full(F.col("text")).alias("folded"))


@query("""WITH h AS (SELECT lang, split_part(text, chr(10), 1) AS form FROM documents), f AS (SELECT lang, form, count(*) AS n FROM h GROUP BY lang, form)
    SELECT lang, sum(n)::BIGINT AS n_headings, count(*) AS n_forms, count_if(n = 1)::BIGINT AS n_single, round(100.0 * max(n) / sum(n), 1)::DOUBLE AS pct_dominant FROM f GROUP BY lang""")
def heading_forms(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select("lang", F.split("text", "\n")[0].alias("form"))
    return agreement.heading_forms(h, "lang", "form")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[A-Za-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages""")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("stripped"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') AS code, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), ''), '') AS host FROM pages""")
def url_code_prefix(spark, sf_dir):
    code = F.regexp_extract("url", r"/(\d+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.when(code != "", code).alias("code"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\1', 'g'), chr(1)), 1) AS k FROM pages),
    s AS (SELECT *, sum(regexp_matches(piece, '^<h[1-6]>')::INT) OVER (PARTITION BY page_id ORDER BY k) AS section FROM p)
    SELECT page_id, section::BIGINT AS section, sum(length(trim(regexp_replace(regexp_replace(piece, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))))::BIGINT AS n_chars FROM s GROUP BY page_id, section""")
def sectionise_lines(spark, sf_dir):
    pieces = F.split(F.regexp_replace("html", "(<h[1-6]>)", "\x01$1"), "\x01")
    p = read(spark, sf_dir, "pages").select("page_id", F.posexplode(pieces).alias("k", "piece"))
    w = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    s = p.withColumn("section", F.sum(F.col("piece").rlike("^<h[1-6]>").cast("int")).over(w))
    return s.groupBy("page_id", "section").agg(F.sum(F.length(tx.squeeze(F.regexp_replace("piece", "<[^>]+>", " ")))).alias("n_chars"))


@query(r"""WITH lex AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}*:-]+'), lambda x: x <> '')) AS term FROM benchmark),
    said AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}*:-]+'), lambda x: x <> '')) AS term FROM documents)
    SELECT doc_id, term, count(*) AS n FROM said JOIN lex USING (term) GROUP BY doc_id, term""")
def lexicon_hits(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), r"(?U)[^\p{L}\p{N}*:-]+"), lambda w: w != "")
    lexicon = read(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).distinct()
    return matching.lexicon_hits(read(spark, sf_dir, "documents"), "doc_id", "text", lexicon, "term")


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(upper(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x = 'THE'))::BIGINT AS n FROM documents""")
def bounded_occurrences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", bounded_count(counting_text(F.col("text")), F.lit("THE")).cast("long").alias("n"))


@query(r"""WITH names AS (SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_name FROM part
            UNION ALL SELECT unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 4)) FROM benchmark)),
    forms AS (SELECT name, upper(regexp_replace(name, '\s+', '', 'g')) AS form FROM names),
    canon AS (SELECT doc_id, trim(upper(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), ' ?([*-]) ?', '\1', 'g'))) AS t FROM documents),
    pieces AS (SELECT doc_id, form, string_split(t, form) AS p FROM canon, (SELECT DISTINCT form FROM forms) WHERE contains(t, form)),
    counted AS (SELECT doc_id, form, len(list_filter(range(1, len(p)), lambda i: NOT regexp_matches(right(CASE WHEN p[i] = '' AND i > 1 THEN form ELSE p[i] END, 1), '[\p{L}\p{N}]')
        AND NOT regexp_matches(left(CASE WHEN p[i + 1] = '' AND i + 1 < len(p) THEN form ELSE p[i + 1] END, 1), '[\p{L}\p{N}]'))) AS n FROM pieces)
    SELECT doc_id, name, form, n::BIGINT AS n FROM counted JOIN forms USING (form) WHERE n > 0""")
def entity_counts(spark, sf_dir):
    """All brands, part names and words of the benchmark, counted in one reading of each document."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 4)
    p, b = read(spark, sf_dir, "part"), read(spark, sf_dir, "benchmark")
    names = p.select(F.col("p_brand").alias("name")).unionByName(p.select(F.col("p_name").alias("name"))).unionByName(b.select(F.explode(words).alias("name")))
    return mentions.mention_counts(read(spark, sf_dir, "documents"), "doc_id", "text", names, "name", ambiguous=())


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def contains_join(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return matching.contains_join(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", b, "item").select("doc_id", "item_id")


@query(f"""WITH m AS (SELECT doc_id, lang, source, sha256({_NORM}) AS hash FROM documents),
    s AS (SELECT lang, source, hash, count(*) AS x FROM m GROUP BY ALL), g AS (SELECT lang, source, sum(x) AS n, count(*) AS d, sum(x * (x - 1) / 2) AS i FROM s GROUP BY ALL HAVING sum(x) >= 2)
    SELECT source AS section, count(*) AS n_groups, count_if(d = 1)::BIGINT AS n_uniform, sum(n * (n - 1) / 2)::BIGINT AS n_pairs, sum(i)::BIGINT AS n_identical, round(100.0 * sum(i) / sum(n * (n - 1) / 2), 1)::DOUBLE AS pct_identical FROM g GROUP BY source""")
def uniform_pairs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.col("source").alias("section"), tx.fingerprint(F.col("text"), ()).alias("hash"))
    return agreement.identical_pairs(d, "lang", "section", "hash")


@query("""SELECT lang, source, count(*) AS n_docs, count_if(quality = 1)::BIGINT AS n_true, CASE WHEN bool_and(quality = 1) THEN 'todos' WHEN bool_or(quality = 1) THEN 'misto' ELSE 'nenhum' END AS agreement
    FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""")
def flag_agreement(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("flag", F.col("quality") == 1)
    return agreement.flag_agreement(d, ["lang", "source"], "flag")


_SIGN = "s AS (SELECT conv_id, string_agg(role || ':' || md5(coalesce(text, '')), '|' ORDER BY turn) AS signature FROM conversations GROUP BY conv_id)"


def _signed(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("h", F.concat("role", F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return agreement.signatures(c, "conv_id", "turn", "h")


@query(f"WITH {_SIGN} SELECT conv_id, signature FROM s")
def signatures(spark, sf_dir):
    return _signed(spark, sf_dir)


@query(f"WITH {_SIGN} SELECT count(*) AS n_docs, count(DISTINCT signature) AS n_distinct, count(*) - count(DISTINCT signature) AS n_collapsed FROM s")
def signature_distinct(spark, sf_dir):
    return agreement.collapse(_signed(spark, sf_dir))


@query(f"""WITH m AS (SELECT doc_id, sha256({_NORM}) AS hash FROM documents), j AS (SELECT m.*, l.doc_id IS NULL AS orphan FROM m LEFT JOIN labels l USING (doc_id))
    SELECT hash, count(*) AS n_docs, count_if(orphan)::BIGINT AS n_orphans, CASE WHEN bool_and(orphan) THEN 'todos' WHEN bool_or(orphan) THEN 'misto' ELSE 'nenhum' END AS kind,
        CASE WHEN bool_or(orphan) THEN min(doc_id) FILTER (NOT orphan) END AS replacement FROM j GROUP BY hash""")
def orphan_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text"), ()).alias("hash"))
    return dedup.orphan_groups(d, "hash", "doc_id", read(spark, sf_dir, "labels"))


@query(r"""WITH f AS (SELECT page_id, 'doc_' || regexp_extract(url, '/(\d+)', 1) || '_x' AS file FROM pages),
    k AS (SELECT page_id, file, nullif(regexp_extract(file, '(?:^|_)(\d{1,7})_', 1), '')::BIGINT AS id FROM f)
    SELECT page_id, file, d.source, CASE WHEN d.doc_id IS NOT NULL THEN 'id' END AS via FROM k LEFT JOIN documents d ON d.doc_id = k.id""")
def id_join_fallback(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("doc_"), F.regexp_extract("url", r"/(\d+)", 1), F.lit("_x")).alias("file"))
    register = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("name "), "doc_id").alias("name"), "source")
    out = dedup.join_by_name_or_id(files, "file", register, "name", "doc_id", r"(?:^|_)(\d{1,7})_")
    return out.select("page_id", "file", F.col("register.source").alias("source"), "via")


@query("""SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) < 400, length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def one_per_compound(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return dedup.one_per_compound(d, "source", [F.col("n") < 400, F.desc("n"), "doc_id"])


@query(f"""WITH m AS (SELECT source, sha256({_NORM}) AS hash FROM documents), g AS (SELECT source, count(*) AS n, count(DISTINCT hash) AS d FROM m GROUP BY source)
    SELECT least(d, 13) AS n_texts, count(*) AS n_groups, sum(n)::BIGINT AS n_docs FROM g GROUP BY 1""")
def texts_per_group(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", tx.fingerprint(F.col("text"), ()).alias("hash"))
    return agreement.texts_per_group(d, "source", "hash")


@query(r"""SELECT count_if(regexp_matches(text, '\brs\d+\b'))::BIGINT AS rsid, count_if(regexp_matches(text, '[%#$&*]{3}'))::BIGINT AS noise, count_if(contains(text, '@'))::BIGINT AS mail, count_if(regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{3,}($|[^\p{L}\p{N}_])'))::BIGINT AS codes FROM documents""")
def pattern_documents(spark, sf_dir):
    return agreement.pattern_documents(read(spark, sf_dir, "documents"), "text", {"rsid": r"\brs\d+\b", "noise": r"[%#$&*]{3}", "mail": "@", "codes": r"(^|[^\p{L}\p{N}_])[A-Z]{3,}($|[^\p{L}\p{N}_])"})


@query(r"""WITH b AS (SELECT split_part(source, 'c', 2) AS level, source AS code, count(DISTINCT lang) AS l, count(*) AS n FROM documents GROUP BY ALL)
    SELECT substr(level, 1, 1) AS level, count(*) AS n_codes, sum(l)::BIGINT AS n_labels, sum(n)::BIGINT AS n_docs, max(l) AS most_labels FROM b GROUP BY 1""")
def group_codes(spark, sf_dir):
    digits = F.split_part(F.col("source"), F.lit("c"), F.lit(2))
    d = read(spark, sf_dir, "documents").select(F.concat(F.substring(digits, 1, 1), F.lit("."), digits).alias("code"), "lang")
    return agreement.group_codes(d, "code", "lang")


@query(r"""SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS clean, substr(sha1(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))), 1, 16) AS section_hash FROM documents""")
def sheet_cells(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.strip_controls(F.col("text")).alias("clean"), tx.section_hash(F.col("text")).alias("section_hash"))


@query(name="text_blocks")
def text_blocks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(sec.blocks("text")).alias("k", "block"))


@query("SELECT doc_id, 0::BIGINT AS lost FROM documents")
def text_blocks_lose_nothing(spark, sf_dir):
    """Characters other than white space that blocks lack; 0 everywhere."""
    bare = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", sec.blocks("text").alias("b"))
    return d.select("doc_id", (bare(F.col("text")) - bare(F.array_join("b", " "))).cast("long").alias("lost"))


@query()
def tables_and_figures(spark, sf_dir):
    x = sec.tables_and_figures("text")
    return read(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.*")


@query()
def text_similarity(spark, sf_dir):
    """Similarity of two seeded documents of each source."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    pair = agreement.two_of_each(d, agreement.seeded_sample(d, "source", 300, 42), "source", "doc_id", 42)
    p = pair.groupBy("source").agg(F.max(F.when(F.col("nth") == 1, F.col("text"))).alias("a"), F.max(F.when(F.col("nth") == 2, F.col("text"))).alias("b"))
    return p.select("source", tx.similarity("a", "b").alias("ratio"))


@query()
def seeded_sample(spark, sf_dir):
    return agreement.seeded_sample(read(spark, sf_dir, "documents"), "source", 300, 42)
