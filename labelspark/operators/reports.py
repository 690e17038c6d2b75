"""The corpus in one row of counters, and the report sheets that are projections of it and of the documents' results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.text import joined, percent
from labelspark.operators.analysis import KINDS, yes_no

#: Flags, counters and texts that a document's result brings to the profile.
RESULT = {
    "flags": ("has_pgx", "has_entities", "has_guideline", "substance_has_guideline"),
    "counters": ("failures", "non_verbatim", "model_normalisations", "technical_normalisations", "incomplete_alleles"),
    "provenance": ("pipeline_version", "model_config"),
}


def _document_counters(docs: DataFrame) -> DataFrame:
    used = F.col("usable")
    there = used & F.col("has_result")
    on = lambda *cs: F.count_if(F.coalesce(reduce(lambda a, b: a & b, cs, there), F.lit(False))).cast("long")
    pgx, ent, gl, sub = (F.coalesce(F.col(c), F.lit(False)) for c in RESULT["flags"])
    total = lambda c: F.coalesce(F.sum(F.when(there, F.col(c))), F.lit(0)).cast("long")
    return docs.agg(
        F.count_if(used).cast("long").alias("documents"), on().alias("with_result"), F.count_if(~used).cast("long").alias("unusable"),
        on(pgx).alias("with_pgx"), on(~pgx).alias("without_pgx"), on(pgx, ent).alias("pgx_and_entities"), on(pgx, ~ent).alias("pgx_without_entities"),
        on(gl).alias("with_guideline"), on(~gl).alias("without_guideline"), on(gl, pgx).alias("guideline_and_pgx"), on(gl, ~pgx).alias("guideline_without_pgx"),
        on(sub).alias("substance_with_guideline"), on(sub, ~gl).alias("substance_guideline_not_in_label"),
        *[total(c).alias(f"total_{c}") for c in RESULT["counters"]], on(F.col("failures") > 0).alias("with_failures"), on(F.col("non_verbatim") > 0).alias("with_non_verbatim"),
    )


def _provenance(docs: DataFrame, column: str, missing: str | None) -> DataFrame:
    """One row: a map from value to documents; there are few versions and configurations."""
    value = F.col(column) if missing is None else F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    by = docs.filter(F.col("usable") & F.col("has_result") & value.isNotNull()).groupBy(value.alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(column))


def _mention_counters(mentions: DataFrame) -> DataFrame:
    """Distinct entities are counted after one aggregation by entity, so nothing is expanded for each kind."""
    by = mentions.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("guideline"), F.col("n"))), F.lit(0)).alias("g"))
    total = lambda c, where=None: F.coalesce(F.sum(F.col(c) if where is None else F.when(where, F.col(c))), F.lit(0)).cast("long")
    kind = lambda k: F.col("kind") == k
    return by.agg(
        *[F.count_if(kind(k)).cast("long").alias(f"unique_{k}") for k in KINDS], *[total("n", kind(k)).alias(f"mentions_{k}") for k in KINDS],
        total("n").alias("mentions"), total("g", kind("gene")).alias("gene_mentions_with_guideline"), total("g").alias("mentions_with_guideline"),
    )


def _coverage_counters(covered: DataFrame, substances: DataFrame) -> DataFrame:
    """covered: as analysis.coverage gives it; substances: (doc, substance)."""
    full = F.col("status") == "coberta"
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    docs = covered.groupBy("doc").agg(
        F.count("*").alias("p"), F.count_if(full).alias("f"), F.count_if(F.col("status") == "parcial").alias("h"), F.count_if(F.col("status") == "ausente").alias("a"),
        F.sum(F.size("expected")).alias("pe"), F.sum(F.size("covered")).alias("pc"), flat("expected").alias("e"), flat("covered").alias("c"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count = lambda c: F.count_if(c).cast("long")
    grain = docs.agg(
        total("p").alias("pairs"), total("f").alias("pairs_covered"), total("h").alias("pairs_partial"), total("a").alias("pairs_absent"),
        total("pe").alias("positions"), total("pc").alias("positions_covered"), total(F.size("e")).alias("document_genes"), total(F.size("c")).alias("document_genes_covered"),
        count(F.col("f") == F.col("p")).alias("fully_covered"), count((F.col("f") < F.col("p")) & (F.col("a") < F.col("p"))).alias("partially_covered"), count(F.col("a") == F.col("p")).alias("not_covered"),
        count((F.size("c") > 0) & (F.size("c") < F.size("e"))).alias("covered_with_missing_genes"),
    )
    name = F.lower(F.trim(F.coalesce("substance", F.lit("")))).alias("substance")
    named = docs.select("doc", F.explode("e").alias("gene"), "c").join(substances.select("doc", name), "doc", "left")
    by = named.groupBy("substance", "gene").agg(F.bool_or(F.array_contains("c", F.col("gene"))).alias("x")).agg(F.count("*").alias("substance_genes"), count("x").alias("substance_genes_covered"))
    return grain.crossJoin(by)


def corpus(docs: DataFrame, mentions: DataFrame, covered: DataFrame) -> DataFrame:
    """One row with all counters of the corpus, their percentages and its provenance.

    docs: (doc, substance, usable, has_result, flags, counters and provenance as
    in RESULT); mentions: (doc, kind, value, n, guideline); covered: the coverage
    of each document and guideline. Unusable documents count only as such, those
    without a result only as documents. Each table is aggregated once; what is
    joined here has one row each.
    """
    out = _document_counters(docs).crossJoin(_mention_counters(mentions)).crossJoin(_coverage_counters(covered, docs.select("doc", "substance")))
    out = out.crossJoin(_provenance(docs, "pipeline_version", "desconhecida")).crossJoin(_provenance(docs, "model_config", None))
    shares = {
        "pct_pgx": ("with_pgx", "with_result"), "pct_pgx_and_entities": ("pgx_and_entities", "with_result"), "pct_pgx_without_entities": ("pgx_without_entities", "with_result"), "pct_guideline": ("with_guideline", "with_result"),
        "pct_positions": ("positions_covered", "positions"), "pct_document_genes": ("document_genes_covered", "document_genes"), "pct_substance_genes": ("substance_genes_covered", "substance_genes"),
    }
    return out.withColumns({k: percent(F.col(a), F.col(b)) for k, (a, b) in shares.items()})


def _number(c: Column) -> Column:
    """Thousands apart by a blank."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def _share(part: str, total: str) -> Column:
    return F.concat(F.replace(F.format_number(percent(F.col(part), F.col(total)), 1), F.lit("."), F.lit(",")), F.lit("%"))


def _of(part: str, total: str) -> Column:
    return F.concat(_share(part, total), F.lit(" de "), _number(F.col(total)))


def _listed(counts: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), _number(e["value"]))), " ; ")


def _blocks() -> list[tuple[str, list[tuple[str, str | Callable[[], Column], Callable[[], Column] | None]]]]:
    """(block, rows of (metric, a column's name or what makes an expression, what makes the note)); each block has a denominator of its own."""
    c = F.col
    plural = {"gene": "Genes", "alelo": "Alelos", "diplotipo": "Diplótipos", "rsid": "rsIDs"}
    of = {"gene": "genes", "alelo": "alelos", "diplotipo": "diplótipos", "rsid": "rsIDs"}
    entities: list = []
    for k in KINDS:
        note = (lambda: F.concat(F.lit("das quais "), _number(c("gene_mentions_with_guideline")), F.lit(" em genes com guideline do fármaco"))) if k == "gene" else None
        entities += [(f"{plural[k]} únicos", f"unique_{k}", None), (f"Menções de {of[k]}", f"mentions_{k}", note)]
    return [
        ("1. CORPUS", [("Documentos analisados", "documents", None), ("Documentos com resultado", "with_result", None), ("Excluídos por não terem texto utilizável", "unusable", lambda: F.lit("fora de todos os denominadores"))]),
        ("2. CONTEÚDO FARMACOGENÓMICO (denominador: documentos)", [
            ("Documentos com conteúdo PGx", "with_pgx", lambda: _of("with_pgx", "documents")),
            ("dos quais com entidades extraídas", "pgx_and_entities", lambda: F.concat(_of("pgx_and_entities", "documents"), F.lit("; "), _share("pgx_and_entities", "with_pgx"), F.lit(" dos "), _number(c("with_pgx")), F.lit(" com PGx"))),
            ("dos quais sem nenhuma entidade", "pgx_without_entities", None), ("Documentos sem conteúdo PGx", "without_pgx", None),
        ]),
        ("3. ENTIDADES EXTRAÍDAS (denominador: menções)", [*entities, ("Menções de entidades (total)", "mentions", lambda: F.concat(F.lit("das quais "), _number(c("mentions_with_guideline")), F.lit(" com guideline")))]),
        ("4. GUIDELINES DO FÁRMACO (denominador: documentos)", [
            ("Substância com guideline", "substance_with_guideline", None), ("e o RCM menciona pelo menos um gene", "with_guideline", lambda: _of("with_guideline", "substance_with_guideline")),
            ("mas o RCM não menciona gene nenhum", "substance_guideline_not_in_label", lambda: _of("substance_guideline_not_in_label", "substance_with_guideline")), ("Substância sem guideline", lambda: c("documents") - c("substance_with_guideline"), None),
        ]),
        ("5. COBERTURA (denominador: pares documento × guideline)", [
            ("Pares avaliados", "pairs", None), ("cobertos", "pairs_covered", lambda: _share("pairs_covered", "pairs")), ("parciais", "pairs_partial", None), ("ausentes", "pairs_absent", lambda: _share("pairs_absent", "pairs")),
        ]),
        ("6. COBERTURA (denominador: posições de gene)", [
            ("Posições de gene esperadas", "positions", None), ("Posições cobertas", "positions_covered", None), ("% cobertura (ponderada por guideline)", "pct_positions", None),
            ("Pares documento × gene esperados", "document_genes", None), ("Pares documento × gene cobertos", "document_genes_covered", None), ("% cobertura (pares documento × gene)", "pct_document_genes", None),
            ("Pares substância × gene esperados", "substance_genes", None), ("Pares substância × gene cobertos", "substance_genes_covered", None), ("% cobertura (pares substância × gene)", "pct_substance_genes", None),
        ]),
        ("7. COBERTURA (denominador: documentos com guideline)", [("Totalmente cobertos", "fully_covered", None), ("Parcialmente cobertos", "partially_covered", None), ("Sem cobertura", "not_covered", None)]),
        ("8. QUALIDADE DA EXTRAÇÃO", [
            ("Falhas de extração", "total_failures", None), ("Documentos com pelo menos uma falha", "with_failures", None), ("Excertos não-verbatim", "total_non_verbatim", None), ("Documentos com excertos não-verbatim", "with_non_verbatim", None),
            ("Normalizações nome extenso → símbolo", "total_model_normalisations", None), ("Normalizações técnicas", "total_technical_normalisations", None), ("Alelos incompletos", "total_incomplete_alleles", None),
        ]),
        ("9. PROVENIÊNCIA", [("Versões do pipeline", lambda: _listed("pipeline_version"), None), ("Configurações do modelo", lambda: _listed("model_config"), None)]),
    ]


def summary_sheet(profile: DataFrame) -> DataFrame:
    """The profile as rows (place, block, metric, value, note)."""
    rows = []
    for block, lines in _blocks():
        for metric, value, note in lines:
            own = F.col(value) if isinstance(value, str) else value()
            rows.append(F.struct(F.lit(len(rows)).alias("place"), F.lit(block).alias("block"), F.lit(metric).alias("metric"), own.cast("string").alias("value"), (F.lit("") if note is None else note()).alias("note")))
    return profile.select(F.inline(F.array(*rows)))


def occurrences_sheet(profile: DataFrame) -> DataFrame:
    """(tipo, unicas, mencoes) by kind."""
    rows = [F.struct(F.lit(k).alias("tipo"), F.col(f"unique_{k}").alias("unicas"), F.col(f"mentions_{k}").alias("mencoes")) for k in KINDS]
    return profile.select(F.inline(F.array(*rows)))


#: The documents sheet: header, column, and how it is shown.
DOCUMENT_SHEET = (
    ("Documento", "doc", "text"), ("Medicamento", "medicamento", "text"), ("Substância ativa", "substance", "text"), ("Aliases", "aliases", "list"), ("Código grupo", "grupo_codigo", "text"), ("Grupo farmacoterapêutico", "grupo", "text"),
    ("ATC", "codigo_atc", "text"), ("MeSH ID", "mesh_id", "text"), ("DrugBank ID", "drugbank_id", "text"), ("ChEBI ID", "chebi_id", "text"), ("UMLS CUI", "umls_cui", "text"), ("Tem PGx", "has_pgx", "flag"), ("Tem entidades", "has_entities", "flag"),
    ("Tem guideline (par fármaco-gene)", "has_guideline", "flag"), ("Guideline IDs", "guideline_ids", "list"), ("Substância tem guideline", "substance_has_guideline", "flag"), ("Guideline IDs da substância", "substance_guideline_ids", "list"),
    ("Genes de guideline esperados", "expected", "list"), ("Genes de guideline mencionados", "covered", "list"), ("Genes de guideline EM FALTA", "missing", "list"), ("% cobertura de genes", "pct_covered", "share"), ("Falhas de extração", "failures", "number"),
    ("Excertos não-verbatim", "non_verbatim", "number"), ("Fontes guideline", "guideline_sources", "list"), ("Genes únicos", "unique_gene", "number"), ("Menções genes reais", "mentions_gene", "number"), ("Alelos únicos", "unique_alelo", "number"),
    ("Menções alelos reais", "mentions_alelo", "number"), ("Diplótipos únicos", "unique_diplotipo", "number"), ("Menções diplótipos reais", "mentions_diplotipo", "number"), ("rsIDs únicos", "unique_rsid", "number"), ("Menções rsIDs reais", "mentions_rsid", "number"),
    ("Normalizações nome extenso → símbolo", "model_normalisations", "number"), ("Normalizações técnicas", "technical_normalisations", "number"), ("Star alleles incompletos", "incomplete_alleles", "number"), ("Estado", "status", "text"),
)


def documents_sheet(docs: DataFrame, results: DataFrame) -> DataFrame:
    """All 36 columns of every document of docs (doc, ...) with its row of results, of which any column may be missing; a document without result is blank but for its status."""
    out = docs.join(results.withColumn("_there", F.lit(True)), "doc", "left")
    there, has = F.coalesce("_there", F.lit(False)), set(out.columns)

    def cell(name: str, kind: str) -> Column:
        if name == "status":
            return F.when(there, F.coalesce(F.col("status"), F.lit("")) if name in has else F.lit("analisado")).otherwise("missing_document_unique")
        if name not in has:
            return F.when(there, yes_no(F.lit(False))) if kind == "flag" else F.lit("") if kind in ("text", "list") else F.lit(0)
        c = F.col(name)
        shown = {
            "flag": lambda: F.when(there, yes_no(F.coalesce(c, F.lit(False)))), "list": lambda: F.coalesce(joined(c), F.lit("")), "text": lambda: F.coalesce(c.cast("string"), F.lit("")),
            "number": lambda: F.coalesce(c, F.lit(0)).cast("long"), "share": lambda: F.coalesce(c, F.lit(0.0)),
        }
        return shown[kind]()

    return out.select(*[cell(name, kind).alias(header) for header, name, kind in DOCUMENT_SHEET])


def guideline_entities_sheet(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc, substance, entity, type, mentions, has, guideline_ids) of every listed entity.

    items: (doc, substance, kind, value, guideline_ids array, flag), a row for
    each that a result lists; mentions: (doc, kind, value, n), counted in the text.
    """
    counted = mentions.groupBy("doc", "kind", "value").agg(F.sum("n").alias("mentions"))
    ids = F.filter(F.coalesce("guideline_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    has = (F.size(ids) > 0) | F.coalesce("flag", F.lit(False))
    out = items.join(counted, ["doc", "kind", "value"], "left")
    return out.select("doc", "substance", F.col("value").alias("entity"), F.col("kind").alias("type"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"), yes_no(has).alias("has"), joined(ids).alias("guideline_ids"))
