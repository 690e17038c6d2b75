"""Tolerant accessors, usability, validity and evidence predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import COMMON_WORDS, composed, readability, squeeze

# Limits of the usability cascade.
LEAST_CHARS, LEAST_PER_PAGE, LEAST_WORDS, MOST_CONTROL, LEAST_LETTERS = 400, 120, 3.0, 0.05, 0.35


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def positive_int(c: Column, default: int = 1) -> Column:
    n = to_int(c, default)
    return F.when(n > 0, n).otherwise(default)


def to_bool(c: Column) -> Column:
    """sim, true, yes and positive numbers."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return t.isin("sim", "true", "yes", "1") | (F.coalesce(t.try_cast("int"), F.lit(0)) > 0)


def says_yes(c: Column) -> Column:
    """A document's flag: anything that begins with sim."""
    return F.lower(F.coalesce(c, F.lit(""))).startswith("sim")


def says_sim_or_true(c: Column) -> Column:
    """A passage's flag."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("sim", "true")


def text_or_empty(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*[F.when(text_or_empty(c) != "", text_or_empty(c)) for c in columns])


def entity_value(item: Column) -> Column:
    return first_text(item["entity"], item["variant"], item["symbol"], item["rsid"])


def gene_value(item: Column) -> Column:
    return first_text(item["symbol"], item["entity"], item["gene"])


def json_field(raw: Column, *paths: str) -> Column:
    """The first of several places of a JSON object that holds more than blanks: new layouts before old ones."""
    return first_text(*[F.get_json_object(raw, p) for p in paths])


# Where a document's fields stand, in the order in which places are tried.
DOCUMENT_FIELDS = {
    "nome_medicamento": ("$.documento.nome_medicamento", "$.nome_medicamento"),
    "substancia_ativa": ("$.documento.substancia_ativa", "$.substancia_ativa"),
    "codigo_atc": ("$.documento.codigo_atc", "$.codigo_atc"),
    "grupo": ("$.documento.grupo_farmacoterapeutico", "$.grupo_farmacoterapeutico"),
    "grupo_codigo": ("$.documento.grupo_farmacoterapeutico_codigo", "$.grupo_farmacoterapeutico_codigo"),
    "mesh_id": ("$.identificadores_substancia.mesh_id",),
    "chebi_id": ("$.identificadores_substancia.chebi_id",),
    "umls_cui": ("$.identificadores_substancia.umls_cui", "$.identificadores_substancia.mrconso_cui"),
    "mrconso_cui": ("$.identificadores_substancia.mrconso_cui", "$.documento.mrconso_cui", "$.mrconso_cui"),
    "drugbank_id": ("$.identificadores_substancia.drugbank_id", "$.documento.drugbank_id", "$.drugbank_id"),
    "versao_pipeline": ("$.pipeline.pipeline_version", "$.pipeline_version"),
    "modelo": ("$.pipeline.llm.model", "$.modelo"),
}
# Lists, whole numbers, blocks of counts, and old names of the entity lists.
LIST_FIELDS = {"aliases": "$.documento.aliases_substancia_ativa", "exclusivas_de_tabelas": "$.origem_entidades.exclusivas_de_tabelas"}
NUMBER_FIELDS = {
    "falhas_extracao": ("$.qualidade_extracao.falhas_extracao",), "nao_verbatim": ("$.qualidade_extracao.excertos_recompostos", "$.qualidade_extracao.excertos_nao_encontrados"),
    "texto_unicas": ("$.origem_entidades.texto.entidades_unicas",), "texto_mencoes": ("$.origem_entidades.texto.mencoes",), "tabelas_unicas": ("$.origem_entidades.tabelas.entidades_unicas",), "tabelas_mencoes": ("$.origem_entidades.tabelas.mencoes",),
}
COUNT_BLOCKS = (("unique", "$.contagens"), ("extended", "$.contagens_documento"), ("unique", "$.contagens_finais"))
ENTITY_LISTS = {"genes": "document_unique_genes", "star_alleles": "document_unique_star_alleles", "diplotypes": "document_unique_diplotypes", "rsids": "document_unique_rsids"}


def document_fields(raw: Column) -> list[Column]:
    return [json_field(raw, *paths).alias(name) for name, paths in DOCUMENT_FIELDS.items()]


def _json_list(raw: Column, path: str) -> Column:
    """The elements of a JSON list as text; null where there is none."""
    c = F.get_json_object(raw, path)
    return F.when(c.startswith("["), F.from_json(c, "array<string>"))


def _whole(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path).try_cast("double").cast("long"), F.lit(0))


def document_blocks(raw: Column) -> list[Column]:
    """All blocks of a result: document, identifiers, provenance, quality, origin; sums of several places, empty lists and 0 where there is nothing."""
    none = F.array().cast("array<string>")
    numbers = [sum((_whole(raw, p) for p in paths[1:]), _whole(raw, paths[0])).alias(name) for name, paths in NUMBER_FIELDS.items()]
    llm = F.get_json_object(raw, "$.pipeline.llm")
    part = lambda k: F.coalesce(F.get_json_object(llm, f"$.{k}"), F.lit("None"))
    config = F.when(llm.startswith("{") & (llm != "{}"), F.concat(part("model"), F.lit(" temp="), part("temperature"), F.lit(" seed="), part("seed")))
    return [*document_fields(raw), *[F.coalesce(_json_list(raw, p), none).alias(n) for n, p in LIST_FIELDS.items()], *numbers, config.alias("configuracao")]


def counts_block(unique: Column, extended: Column) -> Column:
    """The first block of counts, as JSON, that is an object with something in it."""
    side = {"unique": unique, "extended": extended}
    found = [F.get_json_object(side[s], p) for s, p in COUNT_BLOCKS]
    return F.coalesce(*[F.when(c.startswith("{") & (c != "{}"), c) for c in found])


def entity_list(raw: Column, category: str) -> Column:
    """The first list of a category: of the new layout, of the one before, under its old name; else empty."""
    places = (f"$.entidades.{category}", f"$.entidades_unicas.{category}", f"$.{ENTITY_LISTS[category]}")
    return F.coalesce(*[_json_list(raw, p) for p in places], F.array().cast("array<string>"))


def usability(text: Column, pages: Column | None = None, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    """digital, scanned, corrupt, or unknown where there is no text layer to judge (null)."""
    m = readability(text, words)
    size = F.length(squeeze(text))
    out = F.when(text.isNull(), "unknown").when(size < LEAST_CHARS, "scanned")
    if pages is not None:
        out = out.when((pages > 0) & (size / pages < LEAST_PER_PAGE), "scanned")
    return out.when(m["control_fraction"] > MOST_CONTROL, "corrupt").when(m["word_density"] < LEAST_WORDS, "corrupt").when(m["letter_fraction"] < LEAST_LETTERS, "corrupt").otherwise("digital")


def readable(text: Column, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    """Whether a text passes the preflight, which judges it composed and in single spaces."""
    return F.coalesce(usability(squeeze(composed(text)), None, words) == "digital", F.lit(False))


def problems(folder: Column, sections: Column, output: Column, substance: Column) -> Column:
    """What is wrong with a result: no folder, no sections, no output, no substance, none of the core sections."""
    empty = F.size(F.coalesce(sections, F.array().cast("array<string>"))) <= 0
    core = F.arrays_overlap(F.coalesce(sections, F.array().cast("array<string>")), F.array(F.lit("4.2"), F.lit("4.4"), F.lit("5.1")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = ((blank(folder), "pasta em falta"), (empty, "sem seccoes"), (~F.coalesce(output, F.lit(False)), "saida em falta"), (blank(substance), "sem substancia ativa"), (~empty & ~core, "sem seccoes nucleares"))
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))


def has_pgx(classified: Column, root: Column, any_section: Column, has_entities: Column) -> Column:
    """The first flag that is there: the classification, the root, the sections, the entities."""
    return F.coalesce(classified, root, F.when(any_section, True), has_entities, F.lit(False))


def has_entities(counts: Column, categories: list[Column]) -> Column:
    some = F.coalesce(counts, F.lit(0)) > 0
    for c in categories:
        some = some | (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    return some


def has_guideline(ids: Column, flag: Column, source: Column) -> Column:
    """Ids, the flag, or a guideline as source; being in a dictionary or a variant table is no evidence."""
    none = F.array().cast("array<string>")
    return (F.size(F.filter(F.coalesce(ids, none), lambda x: F.trim(x) != "")) > 0) | F.coalesce(flag, F.lit(False)) | F.coalesce(source, F.lit(False))


def clamp_limit(value, default: int = 100, most: int = 1000) -> int:
    """A request's limit: the default where it is no positive number, never more than the most."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return default if n < 1 else min(n, most)


def optional(df, **wanted):
    """Rows equal in the columns for which a value is given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df
