"""Queries over literal rows: semantics that the shared tables do not exercise. The SQL side states the expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark.functions import entities as ent
from labelspark.functions import fidelity as fid
from labelspark.functions import sections as sec
from labelspark.functions import substances as sub
from labelspark.functions import text as tx
from labelspark.operators import agreement, analysis, dedup, filters, matching
from labelspark.plans import store
from labelspark.plans.registry import query, rows, table
from labelspark.sources import readers, sinks
from labelspark.streaming import incremental


def _cases(name: str, schema: str, values: list[tuple], column: str, build, note: str = ""):
    """A query that computes one column of each case and states it as SQL; the last value of a case is what is expected."""
    head = ", ".join(c.strip().split(" ")[0] for c in schema.split(","))
    first = head.split(", ")[0]
    expected = [(r[0], r[-1]) for r in values]

    @query(table(f"{first}, {column}", expected), name=name)
    def run(spark, sf_dir):
        return rows(spark, schema, [r[:-1] for r in values]).select(first, build().alias(column))

    run.__doc__ = note
    return run


c = F.col
_cases("boundary_match", "id int, value string, query string", [
    (1, "spironolactone", "iron", False), (2, "simvastatin acid", "simvastatin", True), (3, "tenofovir disoproxil fumarate", "tenofovir disoproxil", True), (4, "hydrochlorothiazide", "chlorothiazide", False),
    (5, "irinotecan hydrochloride", "cloridrato", False), (6, "sodium nitrate", "sodium", False), (7, "(S)-citalopram", "citalopram", False), (8, "ibuprofen", "dexibuprofen", True), (9, "aspirin", "acetylsalicylic acid", True),
    (10, "dipyrone", "metamizole sodium monohydrate", True), (11, "", "x", False), (12, "Citalopram", "citalopram hydrobromide", True), (13, "desmethylnaproxen", "naproxen", False), (14, "Ácido fólico", "acido folico", True),
    (15, "vitamin c", "ascorbic acid", True), (16, "K", "k", True), (17, "s-omeprazole", "omeprazole", False),
], "matched", lambda: sub.matches(c("value"), c("query")))

_cases("substance_split", "id int, text string", [
    (1, "paracetamol + tiocolquicosido", ["paracetamol + tiocolquicosido", "paracetamol", "tiocolquicosido"]), (2, "sulfamethoxazole / trimethoprim", ["sulfamethoxazole / trimethoprim", "sulfamethoxazole", "trimethoprim"]),
    (3, "Vitamin K and analogues", ["Vitamin K and analogues", "Vitamin K"]), (4, "beta-histina, cloridrato", ["beta-histina, cloridrato", "beta-histina"]), (5, "  ", []), (6, "ab; abcd", ["ab; abcd", "abcd"]), (7, "ácido X e cafeína", ["ácido X e cafeína", "ácido X", "cafeína"]),
], "parts", lambda: sub.split_substances(c("text")))

_cases("query_build", "id int, substance string, aliases array<string>", [
    (1, "paracetamol", ["acetaminophen"], ["acetaminophen", "paracetamol"]), (2, "a1 + bbbb", ["Bbbb"], ["Bbbb", "a1 + bbbb"]), (3, None, None, []), (4, "cafeína", ["CAFEINA"], ["CAFEINA"]),
], "queries", lambda: sub.build_queries(c("substance"), c("aliases")))

_cases("substance_clean", "id int, text string", [
    (1, "Cada comprimido contém 500 mg de paracetamol", "de paracetamol"), (2, "Substância ativa: ibuprofeno 400 mg", "ibuprofeno"), (3, "  varfarina ,", "varfarina"), (4, None, ""), (5, "tramadol 37,5 mg", "tramadol"),
], "clean", lambda: tx.clean_substance(c("text")))

_cases("atc_codes", "id int, code string", [(1, "N02BE01", "N02BE01"), (2, " n02-be01 ", "N02BE01"), (3, "N02BE", ""), (4, None, ""), (5, "N02BE011", "")], "atc", lambda: tx.atc_code(c("code")))
_cases("gene_of", "id int, v string", [(1, "CYP2C19*2", "CYP2C19"), (2, "SLCO1B1c.521CC", "SLCO1B1"), (3, "CC", None), (4, "SLCO1B1CC", "SLCO1B1"), (5, "hla-b*15:02", "HLA-B"), (6, " ", None), (7, "*2", None), (8, "rs4149056", None)], "gene", lambda: ent.gene_of(c("v")))
_cases("hla_canonical", "id int, v string", [(1, "HLA-B*1502", "HLA-B*15:02"), (2, "HLA-B*15:02", "HLA-B*15:02"), (3, "hla-a*3101", "HLA-A*31:01"), (4, "HLA-B*15021", "HLA-B*15021"), (5, "CYP2D6*10", "CYP2D6*10")], "canonical", lambda: ent.canonical_hla(c("v")))
_cases("star_alleles", "id int, v string", [(1, "HLAB*1502", "HLA-B*1502"), (2, "hla‐b * 1502 ;", "HLA-B*1502"), (3, "HLA_B*57:01", "HLA-B*57:01"), (4, " cyp2c9 *3", "CYP2C9*3"), (5, None, "")], "allele", lambda: ent.star_allele(c("v")))
_cases("allele_forms", "id int, v string", [
    (1, "HLA-B*57:01", "HLA com dois pontos (forma actual)"), (2, "HLA-B*5701", "HLA sem dois pontos (forma antiga)"), (3, "HLA-B*27", "HLA incompleto (serotipo)"), (4, "CYP2C9*3", "alelo estrela valido"), (5, "SLCO1B1*C", "letra em vez de numero (invalido)"), (6, "SLCO1B1c.521", "variante HGVS, nao alelo"), (7, "x", "outro"),
], "form", lambda: ent.allele_form(c("v")))
_cases("diplotype_forms", "id int, v string", [
    (1, "CYP2C9*1*3", "diplotipo valido"), (2, "SLCO1B1*C*C", "improvisacao (*base*base)"), (3, "CC", "bases soltas, sem gene"), (4, "SLCO1B1CC", "gene + bases (sem c.)"), (5, "slco1b1c.521cc", "genotipo em HGVS (c.NNN + bases)"), (6, "?", "outro"),
], "form", lambda: ent.diplotype_form(c("v")))
_cases("is_diplotype", "id int, v string", [(1, "CYP2C9*1*3", True), (2, "CYP2C9*1", False)], "two", lambda: ent.is_diplotype(c("v")))
_cases("allele_counts", "id int, variant string, text string", [
    (1, "CYP2D6*1", "CYP2D6*10, CYP2D6*17, CYP2D6*1, CYP2D6*100", 1), (2, "CYP2D6*2", "CYP2D6*2xN", 0), (3, "CYP2D6*1", "CYP2D6 *1 e CYP2C19*2", 1), (4, "HLA-B*1502", "HLA-B*1502 HLAB*1502 HLA B*1502", 3), (5, "HLA-B*1502", "hla‑b*1502.", 1), (6, "", "x", 0),
], "n", lambda: ent.allele_count(c("variant"), c("text")))
_cases("ambiguous_counts", "id int, text string, symbol string", [
    (1, "tomar por via oral", "POR", 0), (2, "artrite reumatoide (AR)", "AR", 0), (3, "o gene POR codifica uma enzima", "POR", 1), (4, "polimorfismo do gene ADA. " + "x " * 200 + "ADA", "ADA", 1), (5, None, "POR", 0),
], "n", lambda: ent.ambiguous_count("text", "symbol"))
_cases("yes_no", "id int, answer string", [
    (1, "Sim", True), (2, "Não. O texto refere-se simplesmente ao metabolismo", False), (3, "similar", False), (4, "\n\nSIM, há genes", True), (5, "assim", False), (6, None, False), (7, "sim e não", False), (8, "Resposta:\nsim", True), (9, "Talvez\nnão", False),
], "yes", lambda: tx.affirmative(c("answer")))
_cases("fidelity", "id int, excerpt string, block string", [
    (1, "c.521T > C", "variante c.521T &gt; C do gene", "verbatim"), (2, "recém-nascidos", "em recémnascidos", "verbatim"), (3, "um di­a", "um dia depois", "verbatim"), (4, "isto nao consta do bloco de origem", "outro texto qualquer sem nada em comum", "nao_encontrado"),
    (5, "primeira parte bem comprida do texto segunda parte igualmente comprida", "segunda parte igualmente comprida. meio. primeira parte bem comprida do texto", "recomposto"), (6, "", "x", "nao_encontrado"),
], "state", lambda: fid.fidelity("excerpt", "block"))
_cases("json_salvage", "id int, raw string", [
    (1, '{"a": 1}', '{"a": 1}'), (2, 'Aqui: {"a": 1} e nota {"b": 2}', '{"a": 1}'), (3, '```json\n[1, 2]\n```', "[1, 2]"), (4, 'x {"a": "}{"} y', '{"a": "}{"}'), (5, "nada", None), (6, "lista [1] fim", "[1]"), (7, None, None),
], "json", lambda: fid.salvaged_json("raw"))
_cases("path_keys_dropped", "id int, raw string", [(1, '{"a": 1, "file_path": "x", "b": {"PATH": 2, "c": [{"path": 1, "d": 3}]}}', '{"a": 1, "b": {"c": [{"d": 3}]}}')], "json", lambda: fid.without_paths("raw"))
_cases("bad_json_paths", "id int, raw string", [(1, "{bad", None), (2, None, None), (3, "", None), (4, '{"path": 1}', "{}"), (5, "[" * 5000, None)], "json", lambda: fid.without_paths("raw"))
_cases("bad_json_strings", "id int, raw string", [(1, "{bad", []), (2, '"x"', ["x"]), (3, "[1, null]", [])], "strings", lambda: fid.json_strings("raw"))
_cases("json_strings", "id int, raw string", [(1, '{"a": "x", "b": ["y", {"c": "z"}], "d": 1}', ["x", "y", "z"]), (2, None, [])], "strings", lambda: fid.json_strings("raw"))
_cases("headings", "id int, line string", [
    (1, "4.4 Advertências", "### 4.4 Advertências"), (2, "## 4 . 2 Posologia", "### 4.2 Posologia"), (3, "4.2. Posologia", "### 4.2 Posologia"), (4, "5.2 Biotransformação).", "# 5. 2 Biotransformação)."), (5, "2. 2.COMPOSIÇÃO", "# 2. COMPOSIÇÃO"),
    (6, "texto normal", "texto normal"), (7, "1. Nome do medicamento", "# 1. Nome do medicamento"), (8, "4.8 Efeitos (raros)", "### 4.8 Efeitos (raros)"), (9, "| 4.2 | x |", "| 4.2 | x |"),
], "heading", lambda: sec.heading(c("line")))
_cases("title_numbers", "id int, title string", [
    (1, "Posologia e modo de administração", "4.2"), (2, "Posologia", "4.2"), (3, "Posologia pediátrica recomendada", None), (4, "Contra-indicações", "4.3"), (5, "Advertências e precauções especiais", "4.4"), (6, "Interações medicamentosas", "4.5"), (7, "Efeitos indesejáveis", "4.8"),
    (8, "Propriedades farmacodinâmicas", "5.1"), (9, "Propriedades farmacocinéticas", "5.2"), (10, "Sobredosagem", None), (11, "", None),
], "number", lambda: sec.number_of_title(c("title")))
_cases("symbols", "id int, text string", [(1, " 5%", "≥ 5%"), (2, "16 g", "16 µg"), (3, "25 C", "25 °C"), (4, "ab", "a b"), (5, "plano", "plano")], "out", lambda: tx.translate_symbols(c("text")))
#: (text, label, code), as the reference's tests of the group label want them; where they state only a part, the rest follows its rules.
_GROUPS = [
    ("Grupo farmacoterapêutico: 2.9.3 Antidepressores.", "2.9.3 Antidepressores", "2.9.3"), ("Grupos farmacoterapêuticos: 2.9.1 – Sistema nervoso central.", "2.9.1 – Sistema nervoso central", "2.9.1"),
    ("Classificação farmacoterapêutica: 8.3 - Hormonas da tiroide.", "8.3 - Hormonas da tiroide", "8.3"), ("Classe farmacoterapêutica: 6.6 - Suplementos enzimáticos.", "6.6 - Suplementos enzimáticos", "6.6"),
    ("Categoria farmacoterapêutica: 6.6 - Suplementos enzimáticos.", "6.6 - Suplementos enzimáticos", "6.6"), ("Grupo fármaco-terapêutico: 4.3.1.2 antivitaminicos K", "4.3.1.2 antivitaminicos K", "4.3.1.2"),
    ("Grupo Fármaco - Terapêutico: 7.4.2.1 Aparelho geniturinário.", "7.4.2.1 Aparelho geniturinário", "7.4.2.1"), ("Grupo Fármaco-Terapêutico 4.3.1.2 antivitaminicos K", "4.3.1.2 antivitaminicos K", "4.3.1.2"),
    ("5.1 Propriedades farmacodinâmicas\n\nClassificação farmacoterapêutica: 8.5.1.2 - Hormonas e medicamentos\nusados no tratamento das doenças endócrinas. Hormonas sexuais.\nEstrogénios e progestagénios.\nCódigo ATC: G03AA10\n",
        "8.5.1.2 - Hormonas e medicamentos usados no tratamento das doenças endócrinas. Hormonas sexuais. Estrogénios e progestagénios", "8.5.1.2"),
    ("Grupo farmacoterapêutico: 2.9.3 Antidepressores. Código ATC: N06AB06", "2.9.3 Antidepressores", "2.9.3"),
    ("Classificação Farmacoterapêutica: Preparações antiglaucomatosas, dorzolamidaCódigo ATC: S01EC03", "Preparações antiglaucomatosas, dorzolamida", None),
    ("5.1 Propriedades farmacodinâmicas\nCódigo ATC: G04B\nGrupo fármaco-terapêutico: VIII-4 Acidificantes e alcalinizantes\n", "VIII-4 Acidificantes e alcalinizantes", None),
    ("Grupo farmacoterapêutico: 10.1.1 – Medicação antialérgica. Anti-\nhistamínicos H1 sedativos.\n", "10.1.1 – Medicação antialérgica. Anti-histamínicos H1 sedativos", "10.1.1"),
    ("Grupo farmacoterapêutico: 2.9.3 Antidepressores.\n\nA sertralina é um inibidor selectivo da recaptação da serotonina.\n", "2.9.3 Antidepressores", "2.9.3"),
    ("Grupo farmacoterapêutico: 8.5.1.2 Hormonas", "8.5.1.2 Hormonas", "8.5.1.2"), ("Grupo farmacoterapêutico: 3.7 Antidislipidémicos", "3.7 Antidislipidémicos", "3.7"), ("Classe farmacoterapêutica: Laxantes osmóticos", "Laxantes osmóticos", None),
    ("5.1 Propriedades farmacodinâmicas\n\nA substância…", None, None), ("", None, None),
    ("Grupo farmacoterapêutico: 4 . 1 . 2 -Sangue . Antianémicos . Medicamentos para tratamento das anemias megaloblásticas\n\nCódigo ATC: B03BB01", "4.1.2 -Sangue. Antianémicos. Medicamentos para tratamento das anemias megaloblásticas", "4.1.2"),
    ("Grupo farmacoterapêutico: 8 .5 .1 .2 Hormonas", "8.5.1.2 Hormonas", "8.5.1.2"), ("Grupo farmacoterapêutico: 2. 9. 3 Psicofármacos", "2.9.3 Psicofármacos", "2.9.3"), ("Grupo farmacoterapêutico: 4 .1. 2 Sangue", "4.1.2 Sangue", "4.1.2"),
    ("Grupo farmacoterapêutico: 6.2.2.3 Aparelho digestivo", "6.2.2.3 Aparelho digestivo", "6.2.2.3"), ("Grupo farmacoterapêutico: 2.12 Analgésicos estupefacientes", "2.12 Analgésicos estupefacientes", "2.12"),
    ("Grupo farmacoterapêutico: 6.2.2.3. Aparelho Digestivo . Antiácidos e antiulcerosos. Inibidores da bomba de protões", "6.2.2.3. Aparelho Digestivo. Antiácidos e antiulcerosos. Inibidores da bomba de protões", "6.2.2.3"),
    ("Classe farmacoterapêutica: Antibióticos beta-\nlactâmicos", "Antibióticos beta-lactâmicos", None), ("Grupo farmacoterapêutico: x,y;z", "x, y; z", None), (None, None, None),
]
_cases("group_labels", "id int, md string", [(k, t, n) for k, (t, _, n) in enumerate(_GROUPS)], "code", lambda: sec.group_label(c("md"))["code"])
_cases("group_label_texts", "id int, md string", [(k, t, n) for k, (t, n, _) in enumerate(_GROUPS)], "label", lambda: sec.group_label(c("md"))["label"])
_cases("atc_in_text", "id int, md string", [
    (1, "código ATC: N02BE01", "N02BE01"), (2, "ATC N02 BE 01", ""), (3, "sem", ""), (4, "CódigoATC: N02BE01", "N02BE01"), (5, "ATC - n02b E01.", "N02BE01"), (6, "Código ATC: G04B\nGrupo fármaco", ""), (7, None, ""), (8, "ATC:\n C09AA02, ATC: N02BE01", "C09AA02"),
], "atc", lambda: sec.atc_in_text(c("md")))
_cases("printed_codes", "id int, md string", [(1, "ATC: N02B E01", "N02B E01"), (2, "ATC", None), (3, "atc n02be01", "n02be01")], "code", lambda: sec.printed_code(c("md")))
_cases("section_keys", "id int, numero string, titulo string", [(1, "4.2", "x", "4.2 Posologia e modo de administração"), (2, "6.1", "Excipientes", "6.1 Excipientes"), (3, None, "Título", "Título")], "key", lambda: sec.section_key(c("numero"), c("titulo")))
_cases("medicine_names", "id int, md string", [(1, "# 1. NOME\n\n Ben-u-ron \n# 2. COMP\nx", "Ben-u-ron"), (2, "sem", "")], "name", lambda: sec.medicine_name(c("md")))
_cases("top_sections", "id int, md string", [(1, "# 1. A\na\n# 2. B\nb1\nb2\n# 3. C\nc", "b1\nb2\n"), (2, "# 2. B\nfim", "fim")], "text", lambda: sec.top_section(c("md"), 2))
_cases("usability_cases", "id int, text string, pages int", [
    (1, None, 1, "unknown"), (2, "", 1, "scanned"), (3, "curto", 1, "scanned"), (4, "o medicamento de dose para doentes com efeitos " * 20, 1, "digital"), (5, "o medicamento de dose para doentes com efeitos " * 20, 50, "scanned"), (6, "xyz " * 200, 1, "corrupt"), (7, "de que para com " * 30 + "\x01" * 100, 1, "corrupt"),
    (8, "de 1234567890 " * 60, 1, "corrupt"),
], "status", lambda: filters.usability(c("text"), c("pages")))
_cases("preflight_readable", "id int, text string", [(1, "o medicamento de dose para doentes com efeitos " * 20, True), (2, "curto", False), (3, None, False)], "ok", lambda: filters.readable(c("text")))
_cases("result_problems", "id int, folder string, sections array<string>, output boolean, substance string", [
    (1, "a", ["4.2"], True, "x", []), (2, None, [], False, "", ["pasta em falta", "sem seccoes", "saida em falta", "sem substancia ativa"]), (3, "a", ["4.8"], True, "x", ["sem seccoes nucleares"]),
], "problems", lambda: filters.problems(c("folder"), c("sections"), c("output"), c("substance")))
_cases("has_guideline", "id int, ids array<string>, flag boolean, source boolean", [(1, ["PA1"], None, None, True), (2, [" "], False, False, False), (3, None, True, None, True), (4, None, None, True, True), (5, None, None, None, False)], "has", lambda: filters.has_guideline(c("ids"), c("flag"), c("source")))
_cases("has_pgx", "id int, a boolean, b boolean, s boolean, e boolean", [(1, False, True, True, True, False), (2, None, True, False, False, True), (3, None, None, True, False, True), (4, None, None, False, False, False), (5, None, None, False, True, True)], "has", lambda: filters.has_pgx(c("a"), c("b"), c("s"), c("e")))
_cases("has_entities", "id int, n int, genes array<string>", [(1, 1, None, True), (2, 0, ["x"], True), (3, None, [], False)], "has", lambda: filters.has_entities(c("n"), [c("genes")]))
_cases("tolerant_bool", "id int, v string", [(1, "Sim", True), (2, "true", True), (3, "2", True), (4, "0", False), (5, None, False), (6, "não", False)], "flag", lambda: filters.to_bool(c("v")))
_cases("tolerant_flags", "id int, v string", [(1, "Sim, há", True), (2, "simples", True), (3, "não", False), (4, None, False)], "flag", lambda: filters.says_yes(c("v")))
_cases("passage_flags", "id int, v string", [(1, "Sim", True), (2, "simples", False), (3, "TRUE", True), (4, None, False)], "flag", lambda: filters.says_sim_or_true(c("v")))
_cases("tolerant_int", "id int, v string", [(1, "7", 7), (2, "x", 1), (3, "-3", 1), (4, None, 1)], "n", lambda: filters.positive_int(c("v")))
_cases("first_text", "id int, a string, b string", [(1, " ", "y", "y"), (2, "x ", "y", "x"), (3, None, " ", None)], "v", lambda: filters.first_text(c("a"), c("b")))
_cases("entity_values", "id int, entity string, variant string, symbol string, rsid string", [(1, None, "v", "s", None, "v"), (2, "e", "v", "s", None, "e"), (3, "", None, None, "rs1", "rs1")], "v", lambda: filters.entity_value(F.struct("entity", "variant", "symbol", "rsid")))
_cases("gene_values", "id int, symbol string, entity string, gene string", [(1, "s", "e", "g", "s"), (2, None, "e", "g", "e"), (3, None, "", "g", "g")], "v", lambda: filters.gene_value(F.struct("symbol", "entity", "gene")))
_cases("gene_cells", "id int, cell string", [(1, "COMT ; oprm1", ["COMT", "OPRM1"]), (2, "none", []), (3, None, []), (4, "a,,b", ["A", "B"])], "genes", lambda: tx.gene_cell(c("cell")))
_cases("joined_values", "id int, v array<string>", [(1, ["b", "a", "b"], "a ; b"), (2, [], "")], "cell", lambda: tx.joined(c("v")))
_cases("rendered_counts", "id int, m map<string,int>", [(1, {"b": 2, "a": 1}, "a=1 ; b=2")], "cell", lambda: tx.rendered(c("m")))
_cases("percentages", "id int, a int, b int", [(1, 1, 3, 33.3), (2, 5, 0, 0.0), (3, 1, 8, 12.5)], "pct", lambda: tx.percent(c("a"), c("b")))
_cases("durations", "id int, s int", [(1, 3723, "1h 02m 03s"), (2, 59, "0h 00m 59s")], "d", lambda: sinks.duration(c("s")))
_cases("folded_names", "id int, v string", [(1, "  Ácido  FÓLICO x", "acido folico x"), (2, "café", "cafe"), (3, None, "")], "folded", lambda: tx.fold(c("v")))
_cases("file_names", "id int, v string", [(1, "4.2 Posologia (adultos)", "4_2_posologia_adultos"), (2, "É", "e")], "name", lambda: tx.ascii_safe(c("v")))
_cases("similarity_cases", "id int, a string, b string", [(1, "abcd", "bcde", 0.75), (2, "", "", 1.0), (3, "x", "x", 1.0), (4, "ab", "cd", 0.0)], "ratio", lambda: tx.similarity("a", "b"))
_cases("error_classes", "id int, status int, message string", [
    (1, 429, "", "limite_de_pedidos"), (2, 503, "x", "servidor_indisponivel"), (3, None, "Read timed out", "tempo_esgotado"), (4, None, "Connection refused", "ligacao_falhou"), (5, 500, "?", "erro_desconhecido"),
], "label", lambda: fid.error_label(c("status"), c("message")))
_cases("table_units", f"id int, t {sec.TABLES}", [
    (1, [("1", "Doses", "|a|")], ["tabela_1|Tabela 1: Doses\n|a|"]), (2, [("2", "", "|b|"), ("3", "vazia", " ")], ["tabela_2|Tabela 2\n|b|"]), (3, None, []),
], "units", lambda: F.transform(sec.table_units(c("t")), lambda x: F.concat(x["origem"], F.lit("|"), x["texto"])))
_cases("pruned_guidelines", "id int, v array<string>, ok array<string>", [(1, ["a", "b"], ["b", "c"], ["b"])], "kept", lambda: agreement.pruned(c("v"), c("ok")))
_cases("file_kinds", "id int, maker string", [(1, "Generis Farmacêutica", True), (2, "Pfizer", False), (3, None, False), (4, "Alternativa", False)], "generic", lambda: dedup.is_generic(c("maker")))


def _expected(columns: str, values: list[tuple], name: str | None = None):
    return query(table(columns, values), name=name)


_GENES = ("pos int, symbol string, alternates string, name string, hgnc_id string", [(1, "CYP2D6", "CPD6, P450DB1", "cytochrome P450", "H1"), (2, "TPMT", "CPD6", "thiopurine", "H2"), (3, "cyp2d6", "", "newer", "H3"), (4, " ", "x", "y", "H4")])


@_expected("term, symbol", [("CYP2D6*4", "CYP2D6"), ("cpd6", "CYP2D6"), ("Thiopurine", "TPMT"), ("zzz", None)])
def gene_lookup(spark, sf_dir):
    return matching.resolve_genes(rows(spark, "term string", [("CYP2D6*4",), ("cpd6",), ("Thiopurine",), ("zzz",)]), "term", rows(spark, *_GENES))


@_expected("symbol, name, hgnc_id", [("CYP2D6", "newer", "H3"), ("ZZZ", None, None)])
def gene_enrichment(spark, sf_dir):
    return matching.enrich_genes(rows(spark, "symbol string", [("CYP2D6",), ("ZZZ",)]), rows(spark, *_GENES))


@_expected("gene, n_docs, docs", [("ZZZ", 2, ["a", "b"])])
def genes_without_ids(spark, sf_dir):
    return matching.genes_without_ids(rows(spark, "doc string, gene string", [("a", "ZZZ"), ("b", "ZZZ"), ("a", "TPMT")]), rows(spark, *_GENES))


_VARIANTS = ("pos int, variant string, gene string, chemicals string, level string", [
    (1, "rs1, rs2", "G1", "warfarin; aspirin", "1A"), (2, "rs1", "G1", "simvastatin acid", "2A"), (3, "rs3", "G2", "", "3"), (4, "rs3", "G2", "", "3"),
])


@_expected("id, variant, level", [(1, "rs1", "1A"), (2, "rs1", "2A"), (3, "rs1", "1A"), (3, "rs1", "2A"), (5, "rs2", "1A")])
def variant_lookup(spark, sf_dir):
    asked = rows(spark, "id int, variant string, queries array<string>", [(1, "rs1", ["Warfarin"]), (2, "RS1 ", ["simvastatin"]), (3, "rs1", []), (4, "rs1", ["statin"]), (5, "rs2", ["aspirin"])])
    return matching.variant_matches(asked, matching.explode_variants(rows(spark, *_VARIANTS))).select("id", "variant", "level")


@_expected("id, level", [(3, "1A")])
def variant_best(spark, sf_dir):
    return matching.best_variant(rows(spark, "id int, variant string, queries array<string>", [(3, "rs1", [])]), matching.explode_variants(rows(spark, *_VARIANTS))).select("id", "level")


@_expected("id, gene, level", [(1, "G2", "3")])
def variant_by_gene(spark, sf_dir):
    return matching.variant_matches(rows(spark, "id int, gene string, queries array<string>", [(1, "g2", [])]), rows(spark, *_VARIANTS), "gene").select("id", "gene", "level")


@_expected("id", [(2,)])
def variant_evidence(spark, sf_dir):
    return matching.with_variant_evidence(rows(spark, "id int, gene string, queries array<string>", [(1, "G9", []), (2, "G1", ["aspirin"])]), rows(spark, *_VARIANTS)).select("id")


@_expected("substance, guideline_id, via", [("varfarina", "PA1", "chemicals"), ("metamizol", "PA3", "chemicals"), ("ibuprofeno", "PA2", "text"), ("dex", "PA2", "text")])
def guideline_resolution(spark, sf_dir):
    s = rows(spark, "substance string, query string", [("varfarina", "warfarin"), ("ibuprofeno", "ibuprofen"), ("dex", "dexibuprofen"), ("metamizol", "metamizole sodium"), ("ferro", "iron")])
    g = rows(spark, "guideline_id string, chemicals array<string>, strings array<string>", [("PA1", ["warfarin sodium"], ["ibuprofen"]), ("PA2", [], ["CYP2C9 and ibuprofen"]), ("PA3", ["dipyrone"], []), ("PA4", ["spironolactone"], [])])
    return matching.resolve_guidelines(s, g)


@_expected("entity, guideline_id", [("HLA-B*15:02", "PA1"), ("CYP2C9*2", "PA2"), ("VKORC1", "PA2")])
def guideline_entities(spark, sf_dir):
    e = rows(spark, "entity string, gene string", [("HLA-B*15:02", "HLA-B"), ("CYP2C9*2", "CYP2C9"), ("VKORC1", "VKORC1"), ("TPMT", "TPMT")])
    g = rows(spark, "guideline_id string, genes array<string>, strings array<string>", [("PA1", ["HLA-B"], ["carriers of hla-b*15:02 and others"]), ("PA2", ["CYP2C9"], ["vkorc1", "x"])])
    return matching.guideline_entities(e, g)


_CONCEPTS = ("pos int, cui string, str string, lat string, scui string, sab string, code string", [
    (1, "C1", "Warfarin", "ENG", "", "DRUGBANK", "DB1"), (2, "C2", "warfarin sodium", "ENG", None, "X", "1"), (3, "C1", "coumadin", "ENG", None, "X", "2"), (4, "C3", "acid", "ENG", None, "X", "3"), (5, "C4", "dexibuprofen lysine", "ENG", "S9", "DRUGBANK", " "), (6, "C1", "Varfarina", "POR", None, "X", "9"),
])


@_expected("query, cui, exact, place, vendor_id, english", [("warfarin", "C1", True, 1, "DB1", ["Warfarin", "coumadin"]), ("dexibuprofen", "C4", False, 1, "S9", ["dexibuprofen lysine"]), ("warfarin sodium 5", "C1", False, 1, "DB1", ["Warfarin", "coumadin"]), ("warfarin sodium 5", "C2", False, 2, None, ["warfarin sodium"])])
def concept_match(spark, sf_dir):
    q = rows(spark, "query string", [("warfarin",), ("dexibuprofen",), ("aci",), ("warfarin sodium 5",)])
    k = rows(spark, *_CONCEPTS)
    return matching.concept_details(matching.concept_candidates(q, k), k).select("query", "cui", "exact", "place", "vendor_id", "english")


_FOUND = ("doc string, query_pos int, exact boolean, place int, cui string, english array<string>", [("d", 0, False, 1, "C9", ["nine"]), ("d", 1, True, 1, "C1", ["Warfarin", "two words", "three long words", "B12 x"]), ("e", 0, False, 1, "C5", ["five"])])


@_expected("doc, cui", [("d", "C1"), ("e", "C5")])
def concept_arbitration(spark, sf_dir):
    return matching.arbitrate(rows(spark, *_FOUND)).select("doc", "cui")


@_expected("doc, queries", [("d", ["warfarin", "q", "two words"]), ("e", ["x"])])
def synonym_expansion(spark, sf_dir):
    return matching.add_synonyms(rows(spark, "doc string, queries array<string>", [("d", ["warfarin", "q"]), ("e", ["x"])]), rows(spark, *_FOUND))


@_expected("file, compound, route", [("a", "varfarina", "inn"), ("b", "varfarina", "pt"), ("d", "acido x", "pt")])
def compound_selection(spark, sf_dir):
    r = rows(spark, "file string, name string, atc_label string", [("a", "Varfine", "warfarin"), ("b", "Varfarina 5 mg", "other"), ("c", "varfarinas", "warfarins"), ("d", "Ácido-X gel", None)])
    return matching.select_compounds(r, rows(spark, "compound string, inn string, pt string", [("varfarina", "warfarin", "varfarina"), ("acido x", "", "ácido x")]))


@_expected("file, compound", [("a", "k"), ("b", "longer name"), ("c", "only")])
def compound_assignment(spark, sf_dir):
    return matching.assign_compound(rows(spark, "file string, compound string", [("a", "z"), ("b", "short"), ("b", "longer name"), ("c", "only")]), rows(spark, "file string, compound string", [("a", "k")]))


@_expected("doc, kind, value, mentions, complete", [(1, "star_alleles", "CYP2D6*4", 2, True), (1, "star_alleles", "*4", 1, False), (1, "star_alleles", "TPMT*2", 1, True)])
def model_items_parse(spark, sf_dir):
    a = rows(spark, "doc int, j string", [(1, '{"star_alleles": [{"variant": "CYP2D6*4", "total_mentions": 2}, "*4", {"entity": "TPMT*2", "total_mentions": -1}, {"symbol": " "}]}'), (2, "{}")])
    return fid.model_items(a, "doc", "j", "star_alleles").select("doc", "kind", "value", "mentions", "complete")


@_expected("doc, numero, titulo, content", [("a", "4.2", "Posologia", "tomar\n"[:-1]), ("a", "4.5", "Interações medicamentosas", "x\n## sub\ny")])
def sections_of_label(spark, sf_dir):
    md = "4.2 Posologia\ntomar\n# 5. Interações medicamentosas\nx\n## sub\ny\n4.2 Posologia\nde novo\n6.1 Excipientes\nz"
    t = sec.lines(rows(spark, "doc string, md string", [("a", md)]), "doc", "md").withColumn("line", sec.heading(c("line")))
    return sec.sections(sec.renumbered(t, "doc"), "doc")


@_expected("section, texto_para_entidades, texto_de_content, texto_de_tabelas, n_verbatim, n_recomposto, n_nao_encontrado", [("4.2", "alfa beta\n\nlinha", "alfa beta", "linha", 2, 0, 1)])
def section_evaluation(spark, sf_dir):
    u = rows(spark, "section string, unit int, origem string, texto string", [("4.2", 0, "content", "um alfa beta dois"), ("4.2", 1, "tabela_1", "| linha |")])
    return fid.evaluated(u, rows(spark, "section string, unit int, pos int, texto_original string", [("4.2", 0, 0, "alfa beta"), ("4.2", 0, 1, "inventado de raiz"), ("4.2", 1, 0, "linha")]))


@_expected("doc, annex_page, leaflet_page, n_starts", [("a", 3, 5, 2)])
def annex_bounds(spark, sf_dir):
    return sec.annex_bounds(rows(spark, "doc string, page int, text string", [("a", 1, "1. NOME DO MEDICAMENTO"), ("a", 2, "ver ANEXO II"), ("a", 3, "x\n ANEXO II"), ("a", 4, "NOME DO MEDICAMENTO"), ("a", 5, "FOLHETO INFORMATIVO")]))


@_expected("doc, guideline, expected, covered, missing, status", [("a", "G1", ["CYP2C9", "VKORC1"], ["CYP2C9"], ["VKORC1"], "parcial"), ("a", "G2", ["TPMT"], [], ["TPMT"], "ausente"), ("b", "G2", ["TPMT"], ["TPMT"], [], "coberta")])
def guideline_status(spark, sf_dir):
    e = rows(spark, "doc string, guideline string, gene string", [("a", "G1", "CYP2C9"), ("a", "G1", " vkorc1 "), ("a", "G2", "TPMT"), ("b", "G2", "TPMT"), ("b", "G3", "")])
    return analysis.coverage(e, rows(spark, "doc string, gene string", [("a", "cyp2c9"), ("b", "TPMT")]))


@_expected("ficheiro, gene, estado, genes_em_falta", [("f", "A", "coberta", None), ("f", "B", "ausente", "B")])
def coverage_loader(spark, sf_dir):
    return store.coverage_rows(rows(spark, "ficheiro string, guideline_id string, fonte string, farmaco string, expected array<string>, mentioned array<string>", [("f", "G", "CPIC", "x", ["A", "B"], ["A"])])).select("ficheiro", "gene", "estado", "genes_em_falta")


@_expected("tabela, n, vazia", [("substancia", 2, False), ("documento", 2, False), ("entidade", 2, False), ("entidade_seccao", 2, False), ("passagem", 1, False), ("guideline", 1, False), ("cobertura", 1, False)])
def store_load(spark, sf_dir):
    t = store.load(
        rows(spark, "nome string, cui string, drugbank string, mesh string, aliases string, pos int", [("Varfarina", "C1", None, None, None, 1), ("varfarina", "C2", None, None, None, 2), ("x", None, None, None, None, 3)]),
        rows(spark, "ficheiro string, medicamento string, nome string, pos int", [("a", "A", "Varfarina", 1), ("b", "B", None, 2), ("a", "C", "x", 3)]),
        rows(spark, "ficheiro string, tipo string, valor string, gene string, seccao string, mencoes int", [("a", "gene", "CYP2C9", "CYP2C9", "4.2", 2), ("a", "gene", "CYP2C9", "CYP2C9", "4.5", 3), ("a", "gene", "CC", None, None, 1)]),
        rows(spark, "ficheiro string, seccao string, texto string, pos int", [("a", "4.2", "t", 1), ("a", "4.2", "u", 2)]),
        rows(spark, "ficheiro string, guideline_id string, fonte string, farmaco string, gene string, estado string, genes_em_falta string", [("a", "PA1", "CPIC", "w", "CYP2C9", "coberta", None)]),
    )
    return store.table_counts({k: t[k] for k in store.TABLES})


@_expected("hash, file", [("h", "b"), ("g", "x")])
def representatives(spark, sf_dir):
    return dedup.representatives(rows(spark, "hash string, file string, name string, maker string", [("h", "a", "aaa", "Generis"), ("h", "b", "Ácido", "Roche"), ("h", "c", "acido", "Roche"), ("g", "y", "z", "Teva"), ("g", "x", "z", "Krka")])).select("hash", "file")


@_expected("doc, v, resultado_propagado_de", [("r", 1, None), ("d", 5, None), ("e", 1, "r")])
def propagation_keeps(spark, sf_dir):
    return dedup.propagate(rows(spark, "doc string, v int", [("r", 1), ("d", 5)]), rows(spark, "doc string, representative string", [("d", "r"), ("e", "r"), ("f", "none")]), "doc")


@_expected("doc, v, resultado_propagado_de", [("r", 1, None), ("d", 1, "r"), ("e", 1, "r")])
def propagation_forced(spark, sf_dir):
    return dedup.propagate(rows(spark, "doc string, v int", [("r", 1), ("d", 5)]), rows(spark, "doc string, representative string", [("d", "r"), ("e", "r"), ("f", "none")]), "doc", force=True)


@_expected("doc, representative", [("a", None), ("b", "r"), ("c", "c"), ("d", "c")])
def rebuilt_map(spark, sf_dir):
    d = rows(spark, "doc string, hash string", [("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")])
    return dedup.rebuilt_map(d, rows(spark, "doc string, representative string", [("b", "r")]), "doc", "hash")


@_expected("doc, original, normalized, type, n", [("a", "CYP2D6 *4", "CYP2D6*4", "alelo", 3)])
def merged_notes(spark, sf_dir):
    return analysis.merged_notes(rows(spark, "doc string, original string, normalized string, type string, n int, pos int", [("a", "CYP2D6 *4", "CYP2D6*4", "alelo", 2, 1), ("a", "cyp2d6 *4", "cyp2d6*4", "alelo", 0, 2), ("a", "", "x", "alelo", 1, 3)])).select("doc", "original", "normalized", "type", "n")


@_expected("doc, source, original, n", [("a", "seccao", "x", 1), ("b", "documento", "y", 1), ("c", "agregado", "(sem detalhe)", 4)])
def normalisation_rows(spark, sf_dir):
    shape = "doc string, original string, normalized string, type string, n int"
    return analysis.normalisation_rows(rows(spark, shape, [("a", "x", "X", "gene", 1)]), rows(spark, shape + ", source string", [("b", "y", "Y", "gene", 1, "documento")]), rows(spark, "doc string, n int", [("a", 1), ("c", 4), ("d", 0)])).select("doc", "source", "original", "n")


@_expected("status, cause, n", [("scanned", "Digitalizado, sem texto", 2), ("corrupt", "Texto ilegível", 1)])
def unusable_rows(spark, sf_dir):
    return analysis.unusable_rows(rows(spark, "doc string, status string", [("a", "scanned"), ("b", "scanned"), ("c", "corrupt"), ("d", "digital"), ("e", "unknown")]))


@_expected("doc, reason", [("(nenhum)", None)])
def placeholder_row(spark, sf_dir):
    return analysis.or_placeholder(rows(spark, "doc string, reason string", []), doc="(nenhum)")


@_expected("compound, reason", [("b", "ilegivel"), ("c", "listado sem RCM"), ("d", "fora do corpus")])
def not_found_reasons(spark, sf_dir):
    return analysis.not_found(rows(spark, "compound string", [("a",), ("b",), ("c",), ("d",)]), rows(spark, "compound string", [("a",), ("c",)]), rows(spark, "compound string, usable boolean", [("a", True), ("b", False)]), "compound")


@_expected("expected, found, \"right\", missed, invented", [(3, 3, 2, 1, 1)])
def reference_confusion(spark, sf_dir):
    return agreement.confusion(rows(spark, "doc string, v string", [("a", "x"), ("a", "y"), ("b", "z")]), rows(spark, "doc string, v string", [("a", "x"), ("b", "z"), ("b", "w")]), ["doc", "v"])


@_expected("doc, guidelines, rules_version", [("a", "new", 2), ("b", "kept", 2), ("c", "new", 2)])
def stale_cache(spark, sf_dir):
    cache = rows(spark, "doc string, guidelines string, rules_version int", [("a", "old", 1), ("b", "kept", 2), ("c", None, None)])
    return incremental.refresh(cache, 2, lambda df: df.withColumn("guidelines", F.lit("new")))


@_expected("k, v", [("a", 2), ("b", 1), ("c", 3)])
def upserted(spark, sf_dir):
    return incremental.upsert(rows(spark, "k string, v int", [("a", 1), ("b", 1)]), rows(spark, "k string, v int", [("a", 2), ("c", 3)]), "k")


@_expected("id, t, u", [(1, "a", "A"), (2, "a", "A"), (3, None, None)])
def computed_once(spark, sf_dir):
    return incremental.once_each(rows(spark, "id int, t string", [(1, "a"), (2, "a"), (3, None)]), "t", "u", F.upper("t"))


@_expected("doc, status", [("a", "inutilizavel"), ("b", "sem_estrutura"), ("c", "ok")])
def staged_documents(spark, sf_dir):
    d = rows(spark, "doc string, usable boolean, n int", [("a", False, 0), ("b", True, 0), ("c", True, 2)])
    return incremental.staged(d, [("inutilizavel", ~c("usable")), ("sem_estrutura", c("n") == 0)]).select("doc", "status")


@_expected("doc, file", [("a", "novo.json"), ("b", "antigo.json")])
def path_fallbacks(spark, sf_dir):
    return readers.first_existing(rows(spark, "doc string, file string, path string", [("a", "antigo.json", "1"), ("a", "novo.json", "2"), ("b", "antigo.json", "3"), ("c", "outro", "4")]), ["novo.json", "antigo.json"]).select("doc", "file")


@_expected("doc, text", [("a", "md"), ("b", "pdf"), ("c", None)])
def markdown_fallback(spark, sf_dir):
    return readers.with_markdown(rows(spark, "doc string", [("a",), ("b",), ("c",)]), rows(spark, "doc string, text string", [("a", "md")]), rows(spark, "doc string, text string", [("a", "x"), ("b", "pdf")]))


@_expected("doc", [("b",)])
def usable_documents(spark, sf_dir):
    return readers.split_unusable(rows(spark, "doc string", [("a",), ("b",)]), rows(spark, "doc string", [("a",)]))[0]


@_expected("query, mesh_id", [("a", "D014859"), ("b", "D000001"), ("c", None)])
def mesh_ids(spark, sf_dir):
    return readers.mesh_id(rows(spark, "query string, json string", [("a", '{"ds_meshui": "D014859"}'), ("b", '{"x": "see D000001, D000002"}'), ("c", "{}")]))


@_expected("symbol, name", [("cyp2d6", "newer"), ("TPMT", "thiopurine"), (" ", "y")])
def gene_dictionary_last(spark, sf_dir):
    return readers.last_by_symbol(rows(spark, *_GENES)).select("symbol", "name")


@_expected("de, para, motivo", [("a", "n/a", "m")])
def move_plan(spark, sf_dir):
    f = rows(spark, "path string, target string", [("a", "n/a"), ("b", "b"), ("c", "same"), ("d", "same")])
    return sinks.moves(f, c("target"), F.lit("m"))


@_expected("total, ok, review, duration, mean_s", [(3, 2, 1, "1h 01m 01s", 1220.3)])
def batch_report(spark, sf_dir):
    return sinks.batch_report(rows(spark, "doc string, status string, seconds int", [("a", "ok", 3600), ("b", "ok", 60), ("c", "erro", 1)]))


@_expected("doc, json", [("a", '{"x":1}')])
def result_json(spark, sf_dir):
    return sinks.results_json(rows(spark, "doc string, x int, y string", [("a", 1, None)]), ["x", "y"])


@_expected("k, v, file_order", [("x", "first", 1)])
def first_wins(spark, sf_dir):
    return dedup.ordered_distinct(rows(spark, "k string, v string, file_order int", [("x", "second", 2), ("x", "first", 1)]), ["k"], ["file_order"])


@_expected("metric, value", [("n", 3.0), ("m", 2.5)])
def summary_sheet(spark, sf_dir):
    return analysis.report_summary(rows(spark, "n int, m double", [(3, 2.5)]))


@_expected("id, nome_medicamento, codigo_atc, mrconso_cui, modelo", [(1, "Novo", "N02BE01", "C1", "m"), (2, "Antigo", None, "C2", None), (3, None, None, None, None)])
def legacy_fields(spark, sf_dir):
    raw = [(1, '{"documento": {"nome_medicamento": "Novo", "codigo_atc": "N02BE01"}, "nome_medicamento": "x", "identificadores_substancia": {"mrconso_cui": "C1"}, "pipeline": {"llm": {"model": "m"}}}'), (2, '{"documento": {"nome_medicamento": " "}, "nome_medicamento": "Antigo", "mrconso_cui": "C2"}'), (3, "{}")]
    return rows(spark, "id int, raw string", raw).select("id", *filters.document_fields(c("raw"))).select("id", "nome_medicamento", "codigo_atc", "mrconso_cui", "modelo")


@_expected("doc, kind, json", [("a", "alelo", '[{"value":"CYP2C9*2","gene":"CYP2C9","total_mentions":3,"sections":["4.2","4.5"],"hgnc_id":"H1","has_variant":true,"guideline_ids":["PA1"],"has_guideline":true}]'), ("a", "gene", '[{"value":"ZZZ","gene":"ZZZ","total_mentions":1,"sections":["4.2"]}]')])
def entity_items(spark, sf_dir):
    i = rows(spark, "doc string, kind string, value string, gene string, section string, n int", [("a", "alelo", "CYP2C9*2", "CYP2C9", "4.2", 1), ("a", "alelo", "CYP2C9*2", "CYP2C9", "4.5", 2), ("a", "gene", "ZZZ", "ZZZ", "4.2", 1)])
    out = analysis.entity_items(i, rows(spark, "gene string, hgnc_id string", [("CYP2C9", "H1")]), rows(spark, "kind string, value string", [("alelo", "CYP2C9*2")]), rows(spark, "value string, guideline_id string", [("CYP2C9*2", "PA1")]))
    return analysis.compact_entities(out.select("doc", "kind", "value", "gene", "total_mentions", "sections", "hgnc_id", "has_variant", "guideline_ids", "has_guideline"))


_RESULT = """{"documento": {"nome_medicamento": "M", "aliases_substancia_ativa": ["a", "b"], "grupo_farmacoterapeutico": "G"}, "identificadores_substancia": {"mesh_id": "D1", "umls_cui": "", "mrconso_cui": "C1"},
    "qualidade_extracao": {"falhas_extracao": 2, "excertos_recompostos": "3", "excertos_nao_encontrados": 4}, "origem_entidades": {"texto": {"entidades_unicas": 5, "mencoes": 6}, "tabelas": {"mencoes": "x"}, "exclusivas_de_tabelas": ["e"]},
    "pipeline": {"pipeline_version": "2", "llm": {"model": "m", "temperature": 0.1}}}"""


@query(table("id, nome_medicamento, grupo, mesh_id, umls_cui, aliases, exclusivas_de_tabelas, falhas_extracao, nao_verbatim, texto_unicas, texto_mencoes, tabelas_unicas, tabelas_mencoes, versao_pipeline, configuracao", [
    (1, "M", "G", "D1", "C1", ["a", "b"], ["e"], 2, 7, 5, 6, 0, 0, "2", "m temp=0.1 seed=None"), (2, "old", None, None, None, [], [], 0, 0, 0, 0, 0, 0, "1", None), (3, None, None, None, None, [], [], 0, 0, 0, 0, 0, 0, None, None),
]))
def result_blocks(spark, sf_dir):
    """Document, identifiers, quality, origin and provenance of results in new, old and broken layouts."""
    r = rows(spark, "id int, raw string", [(1, _RESULT), (2, '{"nome_medicamento": "old", "pipeline_version": "1", "pipeline": {"llm": {}}}'), (3, "{broken")])
    out = r.select("id", *filters.document_blocks(c("raw")))
    numbers = [n for n in filters.NUMBER_FIELDS]
    return out.select("id", "nome_medicamento", "grupo", "mesh_id", "umls_cui", "aliases", "exclusivas_de_tabelas", *[F.col(n).cast("int").alias(n) for n in numbers], "versao_pipeline", "configuracao")


_cases("counts_blocks", "id int, u string, e string", [
    (1, '{"contagens": {"a": 1}}', '{"contagens_documento": {"b": 2}}', '{"a":1}'), (2, '{"contagens": {}, "contagens_finais": {"c": 3}}', '{"contagens_documento": {"b": 2}}', '{"b":2}'), (3, '{"contagens_finais": {"c": 3}}', None, '{"c":3}'), (4, '{"contagens": [1]}', "", None),
], "block", lambda: filters.counts_block(c("u"), c("e")))
_cases("entity_lists", "id int, raw string", [
    (1, '{"entidades": {"genes": ["a"]}, "entidades_unicas": {"genes": ["b"]}}', ["a"]), (2, '{"entidades": {"genes": "x"}, "entidades_unicas": {"genes": [{"symbol": "b"}]}}', ['{"symbol":"b"}']), (3, '{"document_unique_genes": ["c", "d"]}', ["c", "d"]), (4, "{}", []), (5, None, []),
], "genes", lambda: filters.entity_list(c("raw"), "genes"))


@query(table("id, term, kind, n", [(1, "CYP2D6", "gene", 1), (1, "CYP2D6*4", "alelo", 1), (1, "alpha beta", "termo", 1), (1, "alpha beta gamma delta", "termo", 1), (2, "rs123", "rsid", 2), (2, "beta gamma", "termo", 1), (3, "delta", "termo", 2)]))
def longest_terms(spark, sf_dir):
    """At each place the longest term counts, whatever its length; alleles and variants have kinds of their own, genes need a digit."""
    genes = matching.entity_lexicon(rows(spark, "symbol string", [("CYP2D6",), ("POR",)]))
    terms = rows(spark, "term string, kind string", [("alpha beta", "termo"), ("alpha beta gamma delta", "termo"), ("beta gamma", "termo"), ("delta", "termo"), ("CYP2D6*4", "gene"), ("rs123", "gene")])
    lexicon = genes.unionByName(terms).withColumn("kind", matching.lexicon_kind(c("term"), c("kind")))
    texts = rows(spark, "id int, text string", [(1, "Alpha beta; alpha BETA gamma delta, cyp2d6 por CYP2D6*4"), (2, "rs123 beta gamma rs123 alpha"), (3, "delta\ndelta"), (4, None), (5, "")])
    return matching.lexicon_hits(texts, "id", "text", lexicon, "term", "kind").select("id", "term", "kind", F.col("n").cast("int").alias("n"))
