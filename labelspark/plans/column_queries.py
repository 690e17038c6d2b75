"""Column functions over values that are made from the shared tables' rows; the SQL side computes the same from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import entities as ent
from labelspark.functions import fidelity as fid
from labelspark.functions import sections as sec
from labelspark.functions import text as tx
from labelspark.operators import analysis, filters
from labelspark.plans.registry import query, read, sql_literal
from labelspark.sources import sinks

_K = "p_partkey"


def _made(name: str, spark_value: str, sql_value: str, run, sql: str, kind: str = "part"):
    """A query over every row of part: v is spark_value, or sql_value in SQL, run makes a column of it, and sql says the same of v."""
    table, key = ("part", _K) if kind == "part" else ("documents", "doc_id")

    @query(f"SELECT {key}, {sql} AS out FROM (SELECT *, {sql_value} AS v FROM {table})", name=name)
    def build(spark, sf_dir):
        return read(spark, sf_dir, table).withColumn("v", F.expr(spark_value)).select(key, run(F.col("v")).alias("out"))

    build.__doc__ = run.__doc__
    return build


def _pick(values: list, key: str, spark: bool) -> str:
    """One of the values by the key."""
    if not spark:
        return f"[{', '.join(map(sql_literal, values))}][{key} % {len(values)} + 1]"
    shown = ", ".join("NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for v in values)
    return f"element_at(array({shown}), cast({key} % {len(values)} + 1 as int))"


def _chosen(name: str, values: list, run, sql: str):
    return _made(name, _pick(values, _K, True), _pick(values, _K, False), run, sql)


_made(
    "atc_codes_of_parts", "concat(char(65 + p_partkey % 26), lpad(p_partkey % 100, 2, '0'), if(p_partkey % 3 = 0, ' - ', ''), if(p_partkey % 2 = 0, 'be', 'C'), lpad(p_partkey % 100, 2, '0'))",
    "chr((65 + p_partkey % 26)::INT) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN ' - ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'be' ELSE 'C' END || lpad((p_partkey % 100)::VARCHAR, 2, '0')",
    tx.atc_code, "CASE WHEN regexp_matches(upper(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')), '^[A-Z][0-9]{2}[A-Z]{2}[0-9]{2}$') THEN upper(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) ELSE '' END",
)
_made("hla_of_parts", "concat(if(p_partkey % 2 = 0, 'HLA-B*', 'hla-dqa1*'), p_partkey % 20000)", "CASE WHEN p_partkey % 2 = 0 THEN 'HLA-B*' ELSE 'hla-dqa1*' END || (p_partkey % 20000)", ent.canonical_hla, r"CASE WHEN regexp_matches(v, '^.*\*\d{4}$') THEN upper(split_part(v, '*', 1)) || '*' || substr(split_part(v, '*', 2), 1, 2) || ':' || substr(split_part(v, '*', 2), 3) ELSE v END")
_made("genes_of_alleles", "concat('cyp', p_size, 'x', if(p_partkey % 3 = 0, concat('*', p_size), if(p_partkey % 3 = 1, concat('c.', p_size), 'CC')))", "'cyp' || p_size || 'x' || CASE p_partkey % 3 WHEN 0 THEN '*' || p_size WHEN 1 THEN 'c.' || p_size ELSE 'CC' END", ent.gene_of, "'CYP' || p_size || 'X'")
_made("allele_forms_of_parts", "concat(if(p_partkey % 4 = 0, 'HLA-B', 'CYP2C9'), '*', if(p_partkey % 5 = 0, 'C', cast(p_partkey % 200 as string)), if(p_partkey % 8 = 0, ':01', ''))", "CASE WHEN p_partkey % 4 = 0 THEN 'HLA-B' ELSE 'CYP2C9' END || '*' || CASE WHEN p_partkey % 5 = 0 THEN 'C' ELSE (p_partkey % 200)::VARCHAR END || CASE WHEN p_partkey % 8 = 0 THEN ':01' ELSE '' END", ent.allele_form, r"""CASE WHEN v LIKE 'CYP2C9*C' THEN 'letra em vez de numero (invalido)' WHEN regexp_matches(v, '^HLA-B\*\d+:\d+$') THEN 'HLA com dois pontos (forma actual)'
    WHEN regexp_matches(v, '^HLA-B\*\d{1,2}$') THEN 'HLA incompleto (serotipo)' WHEN regexp_matches(v, '^CYP2C9\*\d+$') THEN 'alelo estrela valido' ELSE 'outro' END""")
_made("star_alleles_of_parts", "concat(' hla', if(p_partkey % 2 = 0, '_', ''), 'b * ', p_partkey, ' ;')", "' hla' || CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END || 'b * ' || p_partkey || ' ;'", ent.star_allele, "'HLA-B*' || p_partkey")
_made("words_of_parts", "split(p_name, ' ')", "string_split(p_name, ' ')", tx.joined, "array_to_string(list_sort(list_distinct(v)), ' ; ')")
_made("gene_cells_of_parts", "if(p_partkey % 9 = 0, 'N/A', replace(p_name, ' ', if(p_partkey % 2 = 0, ' ; ', ',')))", "CASE WHEN p_partkey % 9 = 0 THEN 'N/A' ELSE replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN ' ; ' ELSE ',' END) END", tx.gene_cell, "CASE WHEN v = 'N/A' THEN []::VARCHAR[] ELSE list_transform(regexp_split_to_array(v, '[;,]'), lambda x: upper(trim(x))) END")
_made("durations_of_parts", "p_partkey * 37", "p_partkey * 37", sinks.duration, "format('{}h {:02d}m {:02d}s', v // 3600, v % 3600 // 60, v % 60)")
_made("shares_of_parts", "struct(p_size as a, p_partkey % 7 as b)", "{'a': p_size, 'b': p_partkey % 7}", lambda v: tx.percent(v["a"], v["b"]), "CASE WHEN v.b = 0 THEN 0.0 ELSE round(100.0 * v.a / v.b, 1) END::DOUBLE")
_made("file_names_of_parts", "concat(p_partkey % 9, '.', p_size, ' Ção (', p_name, ')')", "(p_partkey % 9) || '.' || p_size || ' Ção (' || p_name || ')'", tx.ascii_safe, "(p_partkey % 9) || '_' || p_size || '_cao_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g')")
_made("section_keys_of_parts", "concat(4 + p_partkey % 2, '.', 1 + p_size % 9)", "(4 + p_partkey % 2) || '.' || (1 + p_size % 9)", lambda v: F.substring(sec.section_key(v, F.col("p_name")), 1, 12), "substr(v || ' ' || coalesce(map {'4.2': 'Posologia e modo', '4.3': 'Contraindicações', '4.4': 'Advertências', '4.5': 'Interações', '4.8': 'Efeitos indesejáveis', '5.1': 'Propriedades', '5.2': 'Propriedades'}[v], p_name), 1, 12)")
_made("first_texts_of_parts", "if(p_partkey % 2 = 0, ' ', p_name)", "CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_name END", lambda v: filters.first_text(v, F.when(F.col(_K) % 3 == 0, F.col("p_brand")), F.lit(" last ")), "coalesce(nullif(trim(v), ''), CASE WHEN p_partkey % 3 = 0 THEN p_brand END, 'last')")
_made("whole_numbers_of_parts", "if(p_partkey % 3 = 0, 'x', cast(p_size - 25 as string))", "CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE (p_size - 25)::VARCHAR END", filters.positive_int, "CASE WHEN try_cast(v AS INT) > 0 THEN v::INT ELSE 1 END")
_made("diplotypes_of_parts", "concat(p_name, repeat('*', cast(p_partkey % 4 as int)))", "p_name || repeat('*', (p_partkey % 4)::INT)", ent.is_diplotype, "p_partkey % 4 > 1")
_made("kinds_in_order", "element_at(array('gene', 'alelo', 'diplotipo', 'rsid', 'x'), cast(p_partkey % 5 + 1 as int))", "['gene', 'alelo', 'diplotipo', 'rsid', 'x'][p_partkey % 5 + 1]", lambda v: analysis.kind_order(v).cast("long"), "p_partkey % 5")

_chosen("answers_of_parts", ["Sim", "Não. O texto", "similar", "\n\nSIM, há", "assim", None, "sim e não", "Talvez\nnão", "Resposta:\nsim", "SIM"], tx.affirmative, "p_partkey % 10 IN (0, 3, 8, 9)")
_chosen("flags_of_parts", ["Sim", "true", " YES ", "1", "2", "0", "-1", "nao", None, "talvez"], filters.to_bool, "v IS NOT NULL AND (lower(trim(v)) IN ('sim', 'true', 'yes', '1') OR coalesce(try_cast(v AS INT), 0) > 0)")
_chosen("error_labels_of_parts", ["Rate limit hit", "Read timed out", "Connection refused", "TIMEOUT", None, "boom"], lambda v: fid.error_label(F.when(F.col("p_size") % 4 == 0, 503), v), "CASE WHEN v ILIKE '%rate limit%' THEN 'limite_de_pedidos' WHEN p_size % 4 = 0 THEN 'servidor_indisponivel' WHEN v ILIKE '%timeout%' OR v ILIKE '%timed out%' THEN 'tempo_esgotado' WHEN v ILIKE '%connection%' THEN 'ligacao_falhou' ELSE 'erro_desconhecido' END")
_chosen("titles_of_parts", ["Posologia", "Contra-indicações", "Advertências e precauções", "Interações com outros", "Efeitos indesejáveis", "Sobredosagem", "", "Propriedades farmacodinâmicas", "PROPRIEDADES FARMACOCINÉTICAS"], sec.number_of_title, "['4.2', '4.3', '4.4', '4.5', '4.8', NULL, NULL, '5.1', '5.2'][p_partkey % 9 + 1]")

_made("folded_documents", "text", "text", tx.fold, "trim(regexp_replace(lower(strip_accents(coalesce(v, ''))), '\\s+', ' ', 'g'))", "documents")
_made("cleaned_names", "concat('Substância ativa: ', split_part(text, ' ', 1), ' ', doc_id, ' mg ,')", "'Substância ativa: ' || split_part(text, ' ', 1) || ' ' || doc_id || ' mg ,'", lambda v: F.when(F.col("text").rlike("^[A-Za-z]+ "), tx.clean_substance(v)), "CASE WHEN regexp_matches(text, '^[A-Za-z]+ ') THEN split_part(text, ' ', 1) END", "documents")
_made("documents_with_entities", "struct(n_chars % 3 as n, if(doc_id % 2 = 0, array(lang), array()) as genes)", "{'n': n_chars % 3, 'genes': CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [] END}", lambda v: filters.has_entities(v["n"], [v["genes"]]), "v.n > 0 OR len(v.genes) > 0", "documents")
_made("blocks_of_documents", "text", "text", lambda v: F.size(F.filter(sec.blocks(v), lambda b: F.length(b) > sec.BLOCK)).cast("long"), "0::BIGINT", "documents")
