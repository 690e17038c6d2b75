"""Readers, writers and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from labelspark.functions import sections as sec
from labelspark.operators import dedup, matching
from labelspark.plans import api, statements, store
from labelspark.sources import readers, sinks
from labelspark.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_pdf_files(spark, tmp_path):
    for name in ("a.pdf", "._a.pdf", "x/b.pdf", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert rows(readers.pdf_files(spark, str(tmp_path)), "file") == [("a.pdf",), ("b.pdf",)]
    (tmp_path / "list").write_text("b.pdf\n\n# a.pdf\nmissing.pdf\n")
    assert rows(readers.pdf_files(spark, str(tmp_path), readers.file_list(spark, str(tmp_path / "list"))), "file") == [("b.pdf",)]


def test_whole_texts_keep_carriage_returns(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"| a\r |\r\n4.2 x\n")
    assert [r.text for r in readers.whole_texts(spark, str(tmp_path)).collect()] == ["| a\r |\r\n4.2 x\n"]


def test_section_files(spark, tmp_path):
    d = tmp_path / "doc1"
    d.mkdir()
    good = {"numero": "4.2", "titulo": "Posologia", "content": "x", "avaliacao_farmacogenomica": {"contem_farmacogenomica": "Sim", "pgx_entidades": {"genes": [{"symbol": "TPMT", "total_mentions": 2}, "DPYD"]}}}
    (d / "s.json").write_text(json.dumps(good))
    (d / "none.json").write_text(json.dumps({"numero": "4.3"}))
    (d / "bad.json").write_text("{broken")
    (d / "list.json").write_text("[1]")
    (d / "ATC.json").write_text(json.dumps(good))
    out = readers.section_files(spark, str(tmp_path))
    assert rows(out, "doc", "file", "numero") == [("doc1", "s.json", "4.2")]
    assert len(out.first().avaliacao_farmacogenomica.pgx_entidades.genes) == 2


def test_dictionaries(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Symbol\tAlternate\tName\tPA\tNCBI\tHGNC\tEns\nTPMT\tA, B\tthio\tPA1\t7\tH\tE\n\t\t\t\t\t\t\nDPYD\t\tdihydro\tPA2\t8\tH2\tE2\n")
    genes = readers.gene_dictionary(spark, str(tmp_path / "g.tsv"))
    assert rows(matching.alias_table(genes)) == [("A", "TPMT"), ("B", "TPMT"), ("DIHYDRO", "DPYD"), ("DPYD", "DPYD"), ("THIO", "TPMT"), ("TPMT", "TPMT")]
    (tmp_path / "v.tsv").write_text("variant\tgene\ttype\tlevel\tchemicals\tphenotypes\nrs1, rs2\tG\tT\t1A\twarfarin\tp\n")
    assert rows(matching.explode_variants(readers.variant_dictionary(spark, str(tmp_path / "v.tsv"))), "variant", "chemicals") == [("rs1", "warfarin"), ("rs2", "warfarin")]
    (tmp_path / "c.rrf").write_text("C1|ENG|2|3|4|5|6|7|8|SC|SD|DRUGBANK|12|DB1|Warfarin|15\nshort|row\n")
    assert rows(readers.concepts(spark, str(tmp_path / "c.rrf")), "cui", "lat", "scui", "sab", "code", "str") == [("C1", "ENG", "SC", "DRUGBANK", "DB1", "Warfarin")]


def test_guidelines(spark, tmp_path):
    block = {"id": "PA1", "name": "n", "source": "CPIC", "relatedChemicals": [{"id": "1", "name": "warfarin"}], "relatedGenes": [{"id": "2", "symbol": "CYP2C9", "name": "cyto"}]}
    (tmp_path / "a.json").write_text(json.dumps({"guideline": block}))
    (tmp_path / "b.json").write_text(json.dumps([block | {"id": "PA2"}, {"guideline": block | {"id": "PA3", "relatedChemicals": []}}]))
    out = readers.guidelines(spark, str(tmp_path))
    assert rows(out, "guideline_id", "source", "chemicals", "genes") == [("PA1", "CPIC", ["warfarin"], ["CYP2C9", "cyto"]), ("PA2", "CPIC", ["warfarin"], ["CYP2C9", "cyto"]), ("PA3", "CPIC", [], ["CYP2C9", "cyto"])]


def test_register_log_and_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_text("med_id,drug_name,active_substance,atc_codes,atc_labels,mah,pharma_form,rcm_filename,has_rcm,rcm_verified\n10020,F,x,N02BE01;A,l,m,p,f.pdf,1,1\n")
    assert rows(readers.register(spark, str(tmp_path / "r.csv")), "med_id", "rcm_filename") == [("10020", "f.pdf")]
    (tmp_path / "f.jsonl").write_text('{"ficheiro": "a", "hash": "1"}\nbad line\n{"ficheiro": "a", "hash": "2"}\n{"ficheiro": "b", "hash": "3"}\n')
    assert rows(readers.fingerprint_log(spark, str(tmp_path / "f.jsonl")), "ficheiro", "hash") == [("a", "2"), ("b", "3")]
    (tmp_path / "l.txt").write_text("1. varfarina;warfarin\n# no\n\n2) x\ty\nz\n")
    assert rows(readers.compound_list(spark, str(tmp_path / "l.txt")), "compound", "inn") == [("varfarina", "warfarin"), ("x", "y"), ("z", "z")]


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("a", "4.2", "Posologia e modo", "t")], "doc string, numero string, titulo string, content string")
    sinks.write_sections(s, str(tmp_path / "s"))
    assert list((tmp_path / "s").rglob("secao=4_2_posologia_e_modo/*.json"))
    sinks.write_sheets({"Resumo": spark.createDataFrame([("a\x01b", 1), (None, 2)], "k string, v int")}, str(tmp_path / "x"))
    assert rows(readers.sheet(spark, str(tmp_path / "x/Resumo"), "k", "k string, v int")) == [("ab", 1)]
    with pytest.raises(ValueError):
        sinks.write_sheets({"a/b": s}, str(tmp_path))
    for names in ({"A": s, "a": s}, {"'a": s}, {"a'": s}, {" ": s}):
        with pytest.raises(ValueError):
            sinks.write_sheets(names, str(tmp_path))
    sinks.write_csv(s, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_fingerprint_stream_restarts(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "doc_id long, text string"
    for k, texts in enumerate((["a b", "c"], ["A  B", "d"])):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(src)
        for run, target in ((incremental.fingerprint_stream, "1"), (incremental.first_texts_stream, "2")):
            run(spark, src, schema, out + target, check + target).awaitTermination()
    every, first = spark.read.parquet(out + "1"), spark.read.parquet(out + "2")
    assert rows(every, "doc_id") == [(0,), (1,), (10,), (11,)] and every.select("hash").distinct().count() == 3
    assert rows(first, "doc_id") == [(0,), (1,), (11,)]


def test_blocks(spark):
    text = "Primeira frase. " * 600 + "\n\n" + "curto\n\n" * 5 + "x" * 13_000
    out = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(sec.blocks("t").alias("b")).collect()
    b = out[0].b
    assert all(len(x) <= sec.BLOCK for x in b) and "".join("".join(b).split()) == "".join(text.split())
    assert out[1].b == [] and out[2].b == []


@pytest.mark.parametrize("sent", [matching.SENT, 0])
def test_contains_join_is_the_nested_loop(spark, monkeypatch, sent):
    """By one automaton, and by the join on keys for more items than that may hold."""
    monkeypatch.setattr(matching, "SENT", sent)
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "ab"), (3, ""), (4, None), (5, "quick brown fox")], "id int, t string")
    items = spark.createDataFrame([("a", "quick brown fox"), ("a2", "quick brown fox"), ("b", "b"), ("c", "ab"), ("d", ""), ("e", None), ("f", "x" * 40)], "k string, item string")
    want = rows(texts.join(items, F.contains("t", "item") & (F.length("item") > 0)), "id", "k")
    assert rows(matching.contains_join(texts, "t", items, "item"), "id", "k") == want


def test_store_and_limits(spark):
    assert [api.clamp_limit(x) for x in (None, "x", 0, -1, "7", 5000)] == [100, 100, 100, 100, 7, 1000]
    with pytest.raises(ValueError):
        api.coverage({}, state="parcial")
    ids = statements.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9), ["k"]).collect()
    assert all(r.id == r.k + 1 for r in ids)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_lots_of_sparse_and_repeated_ids(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ids = [k * k * 1_000_003 for k in range(500)] + [9_000_009] * 30
        out = dedup.lots(spark.createDataFrame([(i,) for i in ids], "i long").repartition(5), 7, "i").collect()
        assert [r.lot for r in sorted(out, key=lambda r: (r.i, r.lot))] == [k // 76 for k in range(530)]
        assert dedup.lots(spark.createDataFrame([], "i long"), 7, "i").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_similarity_of_whole_texts(spark):
    """Texts that differ only far behind their beginning, against difflib."""
    import difflib

    from labelspark.functions import text as tx

    pairs = [("a" * 2500 + "bcd", "a" * 2500 + "xyz"), ("w " * 1500 + "end", "w " * 1500), ("", "x"), (None, None)]
    out = spark.createDataFrame(pairs, "a string, b string").select(tx.similarity("a", "b").alias("r")).collect()
    assert [r.r for r in out] == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_tables_and_figures_lose_nothing(spark):
    """Captions, bodies and figures are found, the longest caption of a number stays, and all other text remains."""
    text = "Antes.\nTabela 1. Doses por peso\n| a | b |\n|---|---|\n| 1 | 2 |\nMeio.\nTabela 1: x\nFigura 2: Curva\nFim."
    x = spark.createDataFrame([(text,), ("sem nada",), (None,)], "t string").select(sec.tables_and_figures("t").alias("x")).collect()
    first = x[0].x
    assert [(t.numero, t.titulo) for t in first.tables] == [("1", "Doses por peso")] and "| 1 | 2 |" in first.tables[0].texto
    assert [(f.numero, f.descricao) for f in first.figures] == [("2", "Curva")]
    assert [w for w in ("Antes.", "Meio.", "Fim.") if w in first.text] == ["Antes.", "Meio.", "Fim."] and "|" not in first.text
    assert (x[1].x.text, x[1].x.tables, x[2].x.text) == ("sem nada", [], "")


def test_seeded_sample(spark):
    """The sample is a function of the seed, of the asked size, and of keys that are there."""
    from labelspark.operators import agreement

    df = spark.createDataFrame([(f"s{k % 50}", k) for k in range(500)], "source string, doc_id int")
    one, again, other = (rows(agreement.seeded_sample(d, "source", 20, seed)) for d, seed in ((df, 42), (df.repartition(7), 42), (df, 43)))
    keys = [r[0] for r in one]
    assert one == again and one != other and len(set(keys)) == 20 and set(keys) <= {f"s{k}" for k in range(50)}


def test_boundary_join_is_the_nested_loop(spark):
    """Names that share salts, names of nothing but salts, punctuation, equivalents and repeated rows."""
    from labelspark.functions import substances as sub

    names = ["sodium", "sodium chloride", "sodium chloride 0.9%", "warfarin sodium", "Warfarina", "warfarin", "(S)-citalopram", "citalopram hydrobromide", "citalopram", "acetylsalicylic acid", "aspirin", "--", "", None, "ácido fólico", "acido folico", "folic acid sodium salt", "valproate sodium", "sodium valproate", "vitamin c", "ascorbic acid", "K"]
    v = spark.createDataFrame([(k, n) for k, n in enumerate(names)] + [(5, "warfarin")], "i int, value string")
    q = spark.createDataFrame([(k, n) for k, n in enumerate(reversed(names))], "j int, query string")
    want = rows(v.crossJoin(q).filter(sub.matches(F.col("value"), F.col("query"))).distinct(), "i", "j")
    assert rows(matching.boundary_join(v, "value", q, "query"), "i", "j") == want and len(want) > 25
