"""Corpus profile, frequencies, gene roll-ups, guideline coverage, sections, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.functions.text import joined, percent

#: The kinds of entities, in the order in which they are listed.
KINDS = ("gene", "alelo", "diplotipo", "rsid")


def kind_order(kind: Column) -> Column:
    out = F.when(kind == KINDS[0], 0)
    for k, name in enumerate(KINDS[1:], 1):
        out = out.when(kind == name, k)
    return out.otherwise(len(KINDS))


def profile(docs: DataFrame) -> DataFrame:
    """One row of counters over (doc, has_pgx, has_entities, has_guideline, n_unique, n_mentions, usable); unusable documents count only as such."""
    used = F.col("usable")
    on = lambda c: F.count_if(used & c).cast("long")
    pgx, ent, gl = F.col("has_pgx"), F.col("has_entities"), F.col("has_guideline")
    return docs.agg(
        F.count_if(used).alias("n_docs"), F.count_if(~used).alias("n_unusable"), on(pgx).alias("n_pgx"), on(~pgx).alias("n_without_pgx"),
        on(ent).alias("n_entities"), on(pgx & ~ent).alias("n_pgx_without_entities"), on(~pgx & ent).alias("n_entities_without_pgx"),
        on(gl).alias("n_guideline"), on(gl & ent).alias("n_guideline_entities"), on(gl & ~pgx).alias("n_guideline_without_pgx"),
        F.coalesce(F.sum(F.when(used, F.col("n_unique"))), F.lit(0)).cast("long").alias("unique_total"),
        F.coalesce(F.sum(F.when(used, F.col("n_mentions"))), F.lit(0)).cast("long").alias("mentions_total"),
        percent(F.count_if(used & pgx), F.count_if(used)).alias("pct_pgx"), percent(F.count_if(used & ent), F.count_if(used & pgx)).alias("pct_entities_of_pgx"),
    )


def frequency(mentions: DataFrame, key: str, n_docs: int, n_pgx: int) -> DataFrame:
    """Per entity of (doc, key, n): documents, mentions, and both percentages."""
    out = mentions.groupBy(key).agg(F.count_distinct("doc").alias("n_docs"), F.sum("n").alias("n_mentions"))
    return out.withColumns({"pct_docs": percent(F.col("n_docs"), F.lit(n_docs)), "pct_pgx": percent(F.col("n_docs"), F.lit(n_pgx))})


def gene_rollup(mentions: DataFrame) -> DataFrame:
    """Per gene of (doc, kind, gene, n): mentions of the symbol, mentions through alleles and diplotypes, and documents as a union."""
    direct = F.col("kind") == "gene"
    return mentions.filter("gene is not null").groupBy("gene").agg(
        F.coalesce(F.sum(F.when(direct, F.col("n"))), F.lit(0)).alias("direct"),
        F.coalesce(F.sum(F.when(~direct, F.col("n"))), F.lit(0)).alias("through"),
        F.sum("n").alias("total"), F.count_distinct("doc").alias("n_docs"),
    )


def section_summary(mentions: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Per section of (doc, section, kind, n): documents, mentions by kind, and the share of all mentions."""
    by = mentions.groupBy("section").agg(
        F.count_distinct("doc").alias("n_docs"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in kinds], F.sum("n").alias("n_mentions")
    )
    return by.crossJoin(mentions.agg(F.sum("n").alias("_all"))).withColumn("pct_mentions", percent(F.col("n_mentions"), F.col("_all"))).drop("_all")


def group_summary(docs: DataFrame) -> DataFrame:
    """Per therapeutic group of (doc, code, label, has_pgx): by code, else label, else `(sem grupo)`; the longest label names it."""
    none = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    key = F.coalesce(none("code"), none("label"), F.lit("(sem grupo)"))
    longest = F.max(F.when(none("label").isNotNull(), F.struct(F.length("label").alias("n"), F.col("label")))).alias("label")
    one = docs.groupBy(key.alias("group"), "doc").agg(longest, F.coalesce(F.bool_or("has_pgx"), F.lit(False)).alias("x"))
    out = one.groupBy("group").agg(F.max("label")["label"].alias("label"), F.count("doc").alias("n_docs"), F.count_if(F.col("x") & F.col("doc").isNotNull()).alias("n_pgx"))
    return out.withColumn("pct_pgx", percent(F.col("n_pgx"), F.col("n_docs")))


def coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per document and guideline of expected (doc, guideline, gene) and observed (doc, gene): covered and missing genes, and the status."""
    norm = lambda c: F.upper(F.regexp_replace(F.col(c), r"\s+", ""))
    e = expected.select("doc", "guideline", norm("gene").alias("gene")).filter("gene <> ''").distinct()
    o = observed.select("doc", norm("gene").alias("gene")).distinct().withColumn("seen", F.lit(True))
    out = e.join(o, ["doc", "gene"], "left").groupBy("doc", "guideline").agg(
        F.array_sort(F.collect_set("gene")).alias("expected"),
        F.array_sort(F.collect_set(F.when(F.col("seen"), F.col("gene")))).alias("covered"),
        F.array_sort(F.collect_set(F.when(F.col("seen").isNull(), F.col("gene")))).alias("missing"),
    )
    return out.withColumn("status", F.when(F.size("missing") == 0, "coberta").when(F.size("covered") > 0, "parcial").otherwise("ausente"))


def coverage_positions(covered: DataFrame, substances: DataFrame) -> DataFrame:
    """(doc, guideline, gene, is_covered, substance) of every expected gene."""
    return covered.select("doc", "guideline", F.explode("expected").alias("gene"), "covered").withColumn("is_covered", F.array_contains("covered", F.col("gene"))).drop("covered").join(substances, "doc", "left")


def coverage_grains(positions: DataFrame) -> DataFrame:
    """Expected and covered at five grains, with percentages: pairs, positions, document and gene, substance and gene, documents."""
    first = positions.groupBy("doc", "guideline").agg(F.bool_and("is_covered").alias("all_"), F.count("*").alias("n"), F.count_if("is_covered").alias("c"))
    pairs = first.groupBy("doc").agg(F.count("*").alias("p"), F.count_if("all_").alias("pc"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    docs = pairs.agg(
        F.sum("p").alias("pairs"), F.sum("pc").alias("pairs_covered"), F.sum("n").alias("positions"), F.sum("c").alias("positions_covered"),
        F.count("*").alias("docs"), F.count_if(F.col("p") == F.col("pc")).alias("docs_full"), F.count_if((F.col("c") > 0) & (F.col("pc") < F.col("p"))).alias("docs_partial"), F.count_if(F.col("c") == 0).alias("docs_none"),
    )
    grain = lambda keys, name: positions.groupBy(*keys).agg(F.bool_or("is_covered").alias("x")).agg(F.count("*").alias(name), F.count_if("x").alias(f"{name}_covered"))
    out = docs.crossJoin(grain(["doc", "gene"], "doc_genes")).crossJoin(grain(["substance", "gene"], "substance_genes"))
    return out.withColumns({f"pct_{k}": percent(F.col(f"{k}_covered"), F.col(k)) for k in ("pairs", "positions", "doc_genes", "substance_genes")})


def coverage_by_gene(positions: DataFrame) -> DataFrame:
    """Per gene: documents and positions, expected and covered. Documents are made distinct first, so no row is expanded for each count."""
    by = positions.groupBy("gene", "doc").agg(F.bool_or("is_covered").alias("x"), F.count("*").alias("n"), F.count_if("is_covered").alias("c"))
    out = by.groupBy("gene").agg(F.count("doc").alias("docs_expected"), F.count_if(F.col("x") & F.col("doc").isNotNull()).alias("docs_covered"), F.sum("n").alias("expected"), F.sum("c").alias("covered"))
    return out.withColumns({"pct_docs": percent(F.col("docs_covered"), F.col("docs_expected")), "pct_positions": percent(F.col("covered"), F.col("expected"))})


def document_guidelines(covered: DataFrame) -> DataFrame:
    """Per document: its guidelines, and expected, covered and missing genes over all of them."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = covered.groupBy("doc").agg(F.array_sort(F.collect_set("guideline")).alias("g"), flat("expected").alias("e"), flat("covered").alias("c"))
    return out.select("doc", joined(F.col("g")).alias("guidelines"), joined(F.col("e")).alias("expected"), joined(F.col("c")).alias("covered"), joined(F.array_except("e", "c")).alias("missing"), percent(F.size("c"), F.size("e")).alias("pct"))


def section_entities(items: DataFrame) -> DataFrame:
    """(doc, section, kind, value, n): mentions by section."""
    return items.groupBy("doc", "section", "kind", "value").agg(F.sum("n").alias("n"))


def unique_entities(items: DataFrame) -> DataFrame:
    """(doc, kind, values): distinct values, sorted."""
    return items.groupBy("doc", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))


def counts_block(items: DataFrame) -> DataFrame:
    """Per document: distinct entities and mentions by kind and in all, and those with a guideline. Entities are made distinct first."""
    one = items.groupBy("doc", "kind", "value").agg(F.sum("n").alias("n"), F.coalesce(F.bool_or("guideline"), F.lit(False)).alias("g"), F.coalesce(F.sum(F.when(F.col("guideline"), F.col("n"))), F.lit(0)).alias("gn"))
    kind = lambda k: F.col("kind") == k
    by = [F.count_if(kind(k) & F.col("value").isNotNull()).alias(f"unique_{k}") for k in KINDS] + [F.coalesce(F.sum(F.when(kind(k), F.col("n"))), F.lit(0)).alias(f"mentions_{k}") for k in KINDS]
    return one.groupBy("doc").agg(*by, F.count("*").alias("unique_total"), F.sum("n").alias("mentions_total"), F.count_if("g").alias("unique_guideline"), F.sum("gn").alias("mentions_guideline"))


def accumulated(items: DataFrame) -> DataFrame:
    """(doc, kind, value, n, sections): repeats of an allele in a section count at their most, all other repeats add up, and sections add up."""
    n = F.when(F.first("kind") == "alelo", F.max("n")).otherwise(F.sum("n"))
    by = items.groupBy("doc", "section", "kind", "value").agg(n.alias("n"))
    return by.groupBy("doc", "kind", "value").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("section")).alias("sections"))


def merged_notes(notes: DataFrame) -> DataFrame:
    """Notes of (doc, original, normalized, type, n, pos) that differ only in case as one, the first spelling kept."""
    return notes.filter((F.trim("original") != "") & (F.trim("normalized") != "")).groupBy("doc", F.lower(F.trim("original")).alias("_o"), F.upper(F.trim("normalized")).alias("_n"), "type").agg(
        F.min_by(F.trim("original"), "pos").alias("original"), F.min_by(F.trim("normalized"), "pos").alias("normalized"), F.sum(F.greatest("n", F.lit(1))).alias("n")
    ).drop("_o", "_n")


def origins(items: DataFrame) -> DataFrame:
    """Per entity of (doc, kind, value, origin, n): mentions in text and in tables, and whether only tables name it."""
    table = F.col("origin") != "content"
    out = items.groupBy("kind", "value").agg(F.coalesce(F.sum(F.when(~table, F.col("n"))), F.lit(0)).alias("n_text"), F.coalesce(F.sum(F.when(table, F.col("n"))), F.lit(0)).alias("n_table"), F.count_distinct("doc").alias("n_docs"))
    return out.withColumn("only_tables", (F.col("n_text") == 0) & (F.col("n_table") > 0))


def normalisation_rows(section_notes: DataFrame, extended_notes: DataFrame, counts: DataFrame) -> DataFrame:
    """Normalisation events (doc, source, original, normalized, type, n) of both sources, and one summary row for documents that count some but list none."""
    rows = section_notes.withColumn("source", F.lit("seccao")).unionByName(extended_notes.withColumn("source", F.lit("documento")), allowMissingColumns=True)
    rest = counts.filter("n > 0").join(rows.select("doc"), "doc", "left_anti").select("doc", F.lit("agregado").alias("source"), F.lit("(sem detalhe)").alias("original"), F.lit("(sem detalhe)").alias("normalized"), F.lit("agregado").alias("type"), "n")
    return rows.unionByName(rest, allowMissingColumns=True)


def forms(entities: DataFrame, form: Column) -> DataFrame:
    """Per kind and form class of (kind, value, n): distinct entities, mentions, and their share of the kind's mentions."""
    out = entities.withColumn("form", form).groupBy("kind", "form").agg(F.count_distinct("value").alias("n_entities"), F.sum("n").alias("n_mentions"))
    return out.withColumn("pct", percent(F.col("n_mentions"), F.sum("n_mentions").over(Window.partitionBy("kind"))))


def entity_items(items: DataFrame, ids: DataFrame, evidence: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Per entity of items (doc, kind, value, gene, section, n) one row with its mentions, sections, dictionary ids, evidence flags and guidelines.

    ids: (gene, ...); evidence: (kind, value) with a clinical variant; guidelines: (value, guideline_id). A dictionary entry is no guideline evidence.
    """
    by = items.groupBy("doc", "kind", "value").agg(F.min("gene").alias("gene"), F.sum("n").alias("total_mentions"), F.array_sort(F.collect_set("section")).alias("sections"))
    g = guidelines.groupBy("value").agg(F.array_sort(F.collect_set("guideline_id")).alias("guideline_ids"))
    v = evidence.select("kind", "value").distinct().withColumn("has_variant", F.lit(True))
    out = by.join(ids, "gene", "left").join(v, ["kind", "value"], "left").join(g, "value", "left")
    return out.withColumns({"has_variant": F.coalesce("has_variant", F.lit(False)), "has_guideline": F.coalesce(F.size("guideline_ids") > 0, F.lit(False))})


def compact_entities(items: DataFrame) -> DataFrame:
    """(doc, kind, json): a document's entities as JSON without empty fields, by value."""
    fields = [c for c in items.columns if c not in ("doc", "kind", "value")]
    full = F.struct("value", *[F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.when(F.col(c), True).alias(c) if t == "boolean" else F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c, t in items.select(*fields).dtypes])
    return items.groupBy("doc", "kind").agg(F.to_json(F.array_sort(F.collect_list(full)), {"ignoreNullFields": "true"}).alias("json"))


def unusable_rows(docs: DataFrame) -> DataFrame:
    """Unusable documents by cause."""
    cause = F.when(F.col("status") == "scanned", "Digitalizado, sem texto").when(F.col("status") == "corrupt", "Texto ilegível").when(F.col("status") == "sem_estrutura", "Sem secções reconhecíveis").otherwise("Outro")
    return docs.filter(~F.col("status").isin("digital", "unknown")).groupBy("status", cause.alias("cause")).agg(F.count("*").alias("n"))


# ---- reports: projections over the tables above


def report_summary(profiled: DataFrame) -> DataFrame:
    """The profile as rows (metric, value)."""
    return profiled.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in profiled.columns]), F.array(*[F.col(c).cast("double") for c in profiled.columns]))).alias("metric", "value"))


def yes_no(c: Column) -> Column:
    return F.when(c, "Sim").otherwise("Não")


def report_documents(docs: DataFrame, results: DataFrame, flags: list[str]) -> DataFrame:
    """All documents with their results; a document without result gets only its status."""
    out = docs.join(results, "doc", "left")
    there = F.col(flags[0]).isNotNull()
    return out.withColumns({f: F.when(there, yes_no(F.col(f))) for f in flags} | {"status": F.when(there, "analisado").otherwise("sem resultado")})


def report_with_without(docs: DataFrame) -> DataFrame:
    """Documents with and without entities among those with content, and how often entities occur against how many there are."""
    n = docs.agg(F.count_if("has_pgx").alias("p"), F.count_if(F.col("has_pgx") & F.col("has_entities")).alias("w"), F.sum("n_mentions").alias("m"), F.sum("n_unique").alias("u"))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in (("com_entidades", F.col("w")), ("sem_entidades", F.col("p") - F.col("w")), ("ocorrencias", F.col("m")), ("unicas", F.col("u")))])
    return n.select(F.inline(rows))


def report_drug_entities(items: DataFrame, substances: DataFrame) -> DataFrame:
    """Per substance: its entities by kind as `value=n` lists."""
    counts = items.join(substances, "doc").groupBy("substance", "kind", "value").agg(F.sum("n").alias("n"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), " ; ")
    return counts.groupBy("substance").agg(*[F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "n")))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), " ; "), F.lit("")).alias(k) for k in KINDS], cell.alias("todas"))


def or_placeholder(rows: DataFrame, **values) -> DataFrame:
    """rows, or one row of the given values where there is none."""
    spark = rows.sparkSession
    one = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(one.join(rows.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti"))


def not_found(wanted: DataFrame, listed: DataFrame, usable: DataFrame, key: str) -> DataFrame:
    """Why a wanted compound has no label: its documents cannot be read, the register lists it without one, or it is not there."""
    out = wanted.join(usable.filter("usable").select(key), key, "left_anti")
    bad = usable.filter("not usable").select(F.col(key).alias("_b")).distinct()
    reg = listed.select(F.col(key).alias("_l")).distinct()
    out = out.join(bad, F.col(key) == F.col("_b"), "left").join(reg, F.col(key) == F.col("_l"), "left")
    return out.select(key, F.when(F.col("_b").isNotNull(), "ilegivel").when(F.col("_l").isNotNull(), "listado sem RCM").otherwise("fora do corpus").alias("reason"))
