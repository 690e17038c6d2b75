"""Joins of names with dictionaries: equal keys, whole words, contained strings, in shared scans."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.substances import GENERIC, expanded, same_substance
from labelspark.functions.text import fold
from labelspark.operators import mentions

#: Characters of a gram by which contained strings are blocked.
GRAM = 12
#: Characters of all items, 16 added for each, up to which they are sent to every task.
SENT = 8_000_000


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def alias_table(genes: DataFrame, longest: int = 120) -> DataFrame:
    """(alias, symbol) of a dictionary (pos, symbol, alternates, name): symbols before alternates before names, then file order; long aliases are left out."""
    g = genes.filter(F.trim("symbol") != "").withColumn("symbol", F.trim("symbol"))
    alternates = F.filter(F.transform(F.split(F.coalesce("alternates", F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda a: a != "")
    rows = g.select("pos", "symbol", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("symbol").alias("alias"))),
        F.transform(alternates, lambda a: F.struct(F.lit(1).alias("rank"), a.alias("alias"))),
        F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.array(F.struct(F.lit(2).alias("rank"), F.trim("name").alias("alias")))).otherwise(F.array().cast("array<struct<rank:int,alias:string>>")),
    )).alias("x"))
    rows = rows.select("pos", "symbol", "x.rank", F.upper("x.alias").alias("alias")).filter(F.length("alias") <= longest)
    return first_by(rows, ["alias"], ["rank", "pos", "symbol"]).select("alias", "symbol")


def resolve_genes(terms: DataFrame, term: str, genes: DataFrame) -> DataFrame:
    """terms with the official symbol of each term (what stands before `*`), null where the dictionary has none."""
    key = F.upper(F.trim(F.split_part(F.col(term), F.lit("*"), F.lit(1))))
    return terms.withColumn("_k", key).join(alias_table(genes), F.col("_k") == F.col("alias"), "left").drop("_k", "alias")


def enrich_genes(symbols: DataFrame, genes: DataFrame) -> DataFrame:
    """symbols with the dictionary's ids and name, those of the last row of a symbol; the bare symbol where it has none."""
    last = first_by(genes.withColumn("_key", F.upper(F.trim("symbol"))), ["_key"], [F.desc("pos")])
    more = [c for c in genes.columns if c not in ("symbol", "pos", "alternates")]
    return symbols.join(last.select(F.col("_key"), *more), F.upper(F.col("symbol")) == F.col("_key"), "left").drop("_key")


def genes_without_ids(mentions: DataFrame, genes: DataFrame) -> DataFrame:
    """Of mentions (doc, gene) the genes that the dictionary lacks, with their documents."""
    known = alias_table(genes).select(F.col("alias").alias("_a"))
    return mentions.join(known, F.upper("gene") == F.col("_a"), "left_anti").groupBy("gene").agg(F.count_distinct("doc").alias("n_docs"), F.array_sort(F.collect_set("doc")).alias("docs"))


def explode_variants(variants: DataFrame) -> DataFrame:
    """One row for each variant of a comma list."""
    each = F.filter(F.transform(F.split("variant", ","), lambda x: F.trim(x)), lambda v: v != "")
    return variants.withColumn("variant", F.explode(each))


def chemicals(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|]"), fold), lambda x: x != "")


def _fits(own: Column, queries: Column) -> Column:
    """No query: every record; else one chemical equals a query or one is a whole word of the other."""
    word = lambda a, b: F.regexp_like(a, F.concat(F.lit(r"(?<![a-z0-9])\Q"), b, F.lit(r"\E(?![a-z0-9])")))
    either = F.exists(own, lambda c: F.exists(queries, lambda q: (c == q) | word(c, q) | word(q, c)))
    return (F.size(queries) == 0) | either


def _fitting(asked: DataFrame, variants: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions (id, _k, _q), records with _k and _c, and (_k, _q, _c): which lists of chemicals fit which queries under a key.

    Both sides have few distinct texts under one key, so texts are compared once
    and neither every question with every record nor a record for each question.
    """
    q = F.transform(F.coalesce("queries", F.array().cast("array<string>")), fold)
    a = asked.select("id", F.upper(F.trim(key)).alias("_k"), F.array_sort(F.array_distinct(F.filter(q, lambda x: x != ""))).alias("_q"))
    v = variants.withColumn("_k", F.upper(F.trim(F.col(key)))).withColumn("_c", F.coalesce(F.col("chemicals"), F.lit("")))
    own = v.select("_k", "_c").distinct().withColumn("_own", chemicals(F.col("_c")))
    fits = a.select("_k", "_q").distinct().join(own, "_k").filter(_fits(F.col("_own"), F.col("_q"))).drop("_own")
    return a, v, fits


def variant_matches(asked: DataFrame, variants: DataFrame, key: str = "variant") -> DataFrame:
    """asked (id, `key`, queries array) joined with the records (pos, variant, gene, chemicals, ...) of that key whose chemicals fit the queries; by gene, equal records of one question once, as the first of them."""
    a, v, fits = _fitting(asked, variants, key)
    asks = a.join(fits, ["_k", "_q"])
    # the matches are many more than the bytes that meet, by which joins are planned: both sides are dealt out by class to a fixed number of tasks
    deal = lambda df: df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "_k", "_c")
    if key == "variant":
        return deal(asks).join(deal(v).hint("merge"), ["_k", "_c"]).drop("_k", "_q", "_c")
    # records and what each question may have are made distinct before they meet
    record = [c for c in v.columns if c != "pos"]
    once = v.groupBy(*record).agg(F.min("pos").alias("pos")).select(*v.columns)
    return deal(asks.select("id", "_k", "_c").distinct()).join(deal(once).hint("merge"), ["_k", "_c"]).drop("_k", "_c")


def best_variant(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """The first fitting record of each id: first found for each list of chemicals, then for each question."""
    a, v, fits = _fitting(asked, variants, "variant")
    best = first_by(fits.join(first_by(v, ["_k", "_c"], ["pos"]), ["_k", "_c"]), ["_k", "_q"], ["pos"])
    return first_by(a.join(best, ["_k", "_q"]).drop("_k", "_q", "_c"), ["id"], ["pos"])


def with_variant_evidence(asked: DataFrame, variants: DataFrame, key: str = "gene") -> DataFrame:
    """The rows of asked that have a fitting record."""
    a, _, fits = _fitting(asked, variants, key)
    return asked.join(a.join(fits, ["_k", "_q"], "left_semi").select("id"), "id", "left_semi")


def _words(c: Column) -> Column:
    """The distinct words of a folded name; the name itself where it has none."""
    words = F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return F.when(F.size(words) > 0, words).otherwise(F.array(c))


def _leading_word(c: Column) -> Column:
    """The one word by which a name is sought in longer ones: the longest that is no salt or other generic word, if there is one."""
    return F.array_max(F.transform(_words(c), lambda w: F.struct((~w.isin(*GENERIC)).alias("own"), F.length(w).alias("n"), w.alias("w"))))["w"]


def boundary_join(values: DataFrame, value: str, queries: DataFrame, query: str) -> DataFrame:
    """Pairs of values and queries that match as substances.

    All words of the shorter name are words of the longer. So each name is filed
    once under its leading word, as the shorter, and once under every word, as
    the longer; the two are joined both ways and the full test runs on those
    pairs only. A salt that very many names hold meets only names of nothing else.
    """
    v = values.withColumn("_v", fold(F.col(value)))
    q = queries.withColumn("_q0", fold(F.col(query))).withColumn("_q", F.explode(expanded(F.col("_q0"))))
    all_words = lambda df, c: df.withColumn("_w", F.explode(_words(F.col(c))))
    leading = lambda df, c: df.withColumn("_w", _leading_word(F.col(c)))
    match = same_substance(F.col("_v"), F.col("_q"))
    pairs = all_words(v, "_v").join(leading(q, "_q"), "_w").filter(match).unionByName(leading(v, "_v").join(all_words(q, "_q"), "_w").filter(match))
    return pairs.select(*values.columns, *queries.columns).distinct()


def resolve_guidelines(substances: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(substance, guideline_id, via): by related chemicals, or, for guidelines that list none, by any string of the record.

    substances: (substance, query); guidelines: (guideline_id, chemicals array, strings array).
    """
    named = guidelines.filter(F.size(F.coalesce("chemicals", F.array().cast("array<string>"))) > 0).select("guideline_id", F.explode("chemicals").alias("name"))
    bare = guidelines.filter(F.size(F.coalesce("chemicals", F.array().cast("array<string>"))) <= 0).select("guideline_id", F.explode("strings").alias("name"))
    rows = [boundary_join(g, "name", substances, "query").select("substance", "guideline_id", F.lit(via).alias("via")) for g, via in ((named, "chemicals"), (bare, "text"))]
    return rows[0].unionByName(rows[1]).distinct()


def guideline_entities(entities: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(entity, guideline_id): the entity inside a string of the guideline, else its gene equal to a related gene's symbol or name, else to any string.

    entities: (entity, gene); guidelines: (guideline_id, genes array, strings array).
    """
    low = lambda c: F.lower(F.trim(c))
    e = entities.select("entity", "gene", low(F.col("entity")).alias("_e"), low(F.col("gene")).alias("_g"))
    strings = guidelines.select("guideline_id", F.explode("strings").alias("s")).withColumn("s", low(F.col("s")))
    inside = contains_join(strings, "s", e.filter(F.col("_e") != ""), "_e").select("entity", "guideline_id")
    rest = e.join(inside.select("entity").distinct(), "entity", "left_anti")
    related = guidelines.select("guideline_id", F.explode("genes").alias("x")).withColumn("x", low(F.col("x")))
    by_gene = rest.join(related, F.col("_g") == F.col("x")).select("entity", "gene", "guideline_id")
    last = rest.join(by_gene.select("entity").distinct(), "entity", "left_anti").join(strings, F.col("_g") == F.col("s")).select("entity", "guideline_id")
    return inside.unionByName(by_gene.select("entity", "guideline_id")).unionByName(last).distinct()


def _grams(n: int):
    """The distinct substrings of n characters."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: list({t[k : k + n] for k in range(len(t or "") - n + 1)}))

    return run


def contains_by_keys(texts: DataFrame, text: str, items: DataFrame, item: str, gram: int = GRAM) -> DataFrame:
    """contains_join for any number of items, none of which is sent to all tasks.

    What stands between two spaces inside an item stands between two spaces in
    every text that contains it: such items are joined on the longest of these
    words with the distinct words of the texts. Other items are joined on their
    first `gram` characters, or all they have, with the texts' substrings of
    that length. Hashes of the texts, not the texts, go through these joins;
    only texts that share a key are then tested in full.
    """
    own, h = [f"_i{k}" for k in range(len(items.columns))], F.xxhash64(F.col(text))
    i = items.filter(F.length(item) > 0).toDF(*own)
    name = own[items.columns.index(item)]
    words = F.split(F.col(name), " ")
    inner = F.filter(F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>")), lambda w: w != "")
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    i = i.withColumn("_key", key)
    hashed = texts.filter(F.length(text) > 0).select(h.alias("_h"), F.col(text).alias("_t"))
    said = hashed.select("_h", F.explode(F.array_distinct(F.split("_t", " "))).alias("_key"))
    pairs = said.join(i.filter(F.col("_key").isNotNull()), "_key").select("_h", *own)
    bare = i.filter(F.col("_key").isNull()).drop("_key").withColumn("_n", F.least(F.length(name), F.lit(gram)))
    for n in sorted(r[0] for r in bare.select("_n").distinct().collect()):
        keyed = bare.filter(F.col("_n") == n).drop("_n").withColumn("_key", F.substring(name, 1, n))
        pairs = pairs.unionByName(hashed.select("_h", F.explode(_grams(n)("_t")).alias("_key")).join(keyed, "_key").select("_h", *own))
    out = texts.withColumn("_h", h).join(pairs.distinct(), "_h").filter(F.contains(F.col(text), F.col(name)))
    return out.select(*[F.col(c) for c in texts.columns], *[F.col(o).alias(c) for o, c in zip(own, items.columns, strict=True)])


def _found(names: list[str]):
    """For each text the numbers of the names that it contains."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, name in enumerate(names):
            automaton.add_word(name, k)
        if names:
            automaton.make_automaton()
        for b in batches:
            hits = [sorted({k for _, k in automaton.iter(t)}) if t and names else [] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "hits"])

    return run


def contains_join(texts: DataFrame, text: str, items: DataFrame, item: str) -> DataFrame:
    """Pairs of texts and items such that the text contains the item; an empty item is in no text.

    Distinct items of together at most SENT characters, which is counted before,
    go to every task as one automaton, which reads each text once and shuffles
    nothing; for more, the join on keys gives the same rows.
    """
    names = items.filter(F.length(item) > 0).select(F.col(item).alias("_i")).distinct()
    chars = names.agg(F.sum(F.length("_i") + 16)).first()[0] or 0
    if chars > SENT:
        return contains_by_keys(texts, text, items, item)
    found = sorted(r[0] for r in names.collect())
    carried = [f"_t{k}" for k in range(len(texts.columns))]
    rows = texts.filter(F.length(text) > 0).toDF(*carried).withColumn("_text", F.col(carried[texts.columns.index(text)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", hits array<int>"
    hits = rows.mapInArrow(_found(found), schema).withColumn("_k", F.explode("hits")).drop("hits")
    own = [f"_i{k}" for k in range(len(items.columns))]
    numbers = items.sparkSession.createDataFrame(list(enumerate(found)), "_k int, _n string")
    numbered = items.filter(F.length(item) > 0).toDF(*own).join(numbers, F.col(own[items.columns.index(item)]) == F.col("_n")).drop("_n")
    out = hits.join(numbered, "_k")
    return out.select(*[F.col(o).alias(c) for o, c in zip(carried, texts.columns, strict=True)], *[F.col(o).alias(c) for o, c in zip(own, items.columns, strict=True)])


def _related(queries: list[str], least: int):
    """For each string the numbers of the queries that equal it, and of those inside it or around it, both of at least `least` characters."""

    def run(batches):
        import ahocorasick

        equal, automaton, grams = {q: k for k, q in enumerate(queries)}, ahocorasick.Automaton(), {}
        for k, q in enumerate(queries):
            if len(q) >= least:
                automaton.add_word(q, k)
                for g in {q[i : i + least] for i in range(len(q) - least + 1)}:
                    grams.setdefault(g, []).append(k)
        if grams:
            automaton.make_automaton()
        for b in batches:
            same, near = [], []
            for s in b.column(b.num_columns - 1).to_pylist():
                same.append([equal[s]] if s in equal else [])
                inside = {k for _, k in automaton.iter(s)} if grams and len(s) >= least else set()
                around = {k for k in grams.get(s[:least], ()) if s in queries[k]} if len(s) >= least else set()
                near.append(sorted((inside | around).difference(same[-1])))
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in (same, near)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], "same", "near"])

    return run


def _related_by_joins(q: DataFrame, c: DataFrame, least: int) -> DataFrame:
    """(query, cui, str, exact, pos) for any number of queries, none of which is sent to all tasks."""
    exact = q.join(c, F.col("_q") == F.col("_s")).select("query", "cui", "str", F.lit(True).alias("exact"), "pos")
    rest, long = q.filter(F.length("_q") >= least), c.filter(F.length("_s") >= least)
    held = contains_join(rest, "_q", long, "_s")
    holds = contains_join(long, "_s", rest, "_q")
    near = [df.filter(F.col("_q") != F.col("_s")).select("query", "cui", "str", F.lit(False).alias("exact"), "pos") for df in (held, holds)]
    return exact.unionByName(near[0]).unionByName(near[1])


def concept_candidates(queries: DataFrame, concepts: DataFrame, least: int = 5, cap: int = 25) -> DataFrame:
    """(query, cui, str, exact, pos) of the concepts (pos, cui, str) of each query: equal folded strings, else strings that hold the query or are held by it, the first `cap` in file order.

    All three are found in one reading of the strings: the queries, counted
    before, go to every task as an automaton, which finds those inside a string,
    and under all their runs of `least` characters, of which a string that lies
    inside a query begins with one. More than SENT characters of queries are
    joined instead, with the same rows. cap is part of what the lookup returns,
    not of how it finds; an exact match comes first, so it is never cut off.
    """
    c = concepts.select("cui", "str", "pos", fold(F.col("str")).alias("_s")).filter(F.col("_s") != "")
    q = queries.select("query", fold(F.col("query")).alias("_q")).filter(F.col("_q") != "").distinct()
    names = q.select("_q").distinct()
    if (names.agg(F.sum(F.length("_q") + 16)).first()[0] or 0) > SENT:
        found = _related_by_joins(q, c, least)
    else:
        sent = sorted(r[0] for r in names.collect())
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema[:-1]) + ", same array<int>, near array<int>"
        hit = lambda column, exact: F.transform(column, lambda k: F.struct(k.alias("_k"), F.lit(exact).alias("exact")))
        hits = c.mapInArrow(_related(sent, least), schema).select("cui", "str", "pos", F.inline(F.concat(hit("same", True), hit("near", False))))
        numbers = queries.sparkSession.createDataFrame(list(enumerate(sent)), "_k int, _q string")
        found = hits.join(q.join(numbers, "_q"), "_k").select("query", "cui", "str", "exact", "pos")
    best = first_by(found, ["query"], [F.desc("exact"), "pos", "cui"], cap)
    return best.withColumn("_any", F.max("exact").over(Window.partitionBy("query"))).filter(F.col("exact") == F.col("_any")).drop("_any")


def concept_details(candidates: DataFrame, concepts: DataFrame, vendor: str = "DRUGBANK", terms: int = 12) -> DataFrame:
    """candidates with the vendor's id (the last row wins) and the shortest English terms of each concept, those with an id first, exact before partial."""
    code = F.when(F.upper("sab") == vendor, F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.nullif(F.trim("scui"), F.lit(""))))
    by = concepts.join(candidates.select("cui").distinct(), "cui", "left_semi").groupBy("cui").agg(
        F.max(F.when(code.isNotNull(), F.struct("pos", code.alias("id"))))["id"].alias("vendor_id"),
        F.slice(F.transform(F.array_sort(F.collect_set(F.when(F.col("lat") == "ENG", F.struct(F.length("str").alias("n"), F.col("str"))))), lambda x: x["str"]), 1, terms).alias("english"),
    )
    w = Window.partitionBy("query").orderBy(F.col("vendor_id").isNull(), F.desc("exact"), "str", "cui")
    return candidates.join(by, "cui", "left").withColumn("place", F.row_number().over(w))


def arbitrate(found: DataFrame) -> DataFrame:
    """Of (doc, query_pos, exact, place, ...) the one match of each document: exact before partial, then the queries' order, then the match's place."""
    return first_by(found, ["doc"], [F.desc("exact"), "query_pos", "place"])


def add_synonyms(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, queries) with the English terms of exact matches that have at most two words and no digit and are not there yet, in order."""
    terms = found.filter("exact").select("doc", "place", F.posexplode("english").alias("k", "term")).filter(~F.col("term").rlike("[0-9]") & (F.size(F.split(F.trim("term"), r"\s+")) <= 2))
    terms = first_by(terms.withColumn("_f", F.lower("term")), ["doc", "_f"], ["place", "k"])
    more = terms.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "k", "term"))), lambda x: x["term"]).alias("more"))
    new = F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda t: ~F.exists("queries", lambda q: F.lower(q) == F.lower(t)))
    return queries.join(more, "doc", "left").select("doc", F.concat("queries", new).alias("queries"))


def select_compounds(register: DataFrame, compounds: DataFrame) -> DataFrame:
    """(file, compound, route): the English group label names the compound (route inn), else the Portuguese name does (route pt).

    register: (file, name, atc_label); compounds: (compound, inn, pt). A name is a whole word, its spaces also hyphens.
    """
    word = lambda c: F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])\Q"), F.regexp_replace(c, r"[\s-]+", r"\\E[\\s-]+\\Q"), F.lit(r"\E(?![\p{L}\p{N}])"))
    first = lambda c: F.split(fold(c), r"[^\p{L}\p{N}]+")[0]

    def route(side: str, name: str, rank: int):
        # equal labels name the same compounds: each distinct one is read once
        said = register.select(F.col(side).alias("_s")).filter(F.col("_s").isNotNull()).distinct().withColumn("_f", fold(F.col("_s")))
        tokens = said.withColumn("_w", F.explode(F.array_distinct(F.split("_f", r"[^\p{L}\p{N}]+"))))
        own = compounds.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").withColumn("_n", fold(F.col(name))).withColumn("_w", first(F.col(name)))
        named = tokens.join(own, "_w").filter(F.regexp_like("_f", word(F.col("_n")))).select("_s", "compound").distinct()
        return register.select("file", F.col(side).alias("_s")).join(named, "_s").select("file", "compound", F.lit(rank).alias("rank"))

    both = route("atc_label", "inn", 0).unionByName(route("name", "pt", 1)).groupBy("file", "compound").agg(F.min("rank").alias("rank"))
    return both.select("file", "compound", F.when(F.col("rank") == 0, "inn").otherwise("pt").alias("route"))


def assign_compound(hits: DataFrame, known: DataFrame) -> DataFrame:
    """(file, compound): as known, else the only hit, else the longest name among several."""
    best = first_by(hits.join(known.select("file"), "file", "left_anti"), ["file"], [F.desc(F.length("compound")), "compound"]).select("file", "compound")
    return known.select("file", "compound").unionByName(best)


def _term_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}*:-]+"), lambda w: w != "")


def lexicon_hits(texts: DataFrame, key: str, text: str, lexicon: DataFrame, term: str, kind: str | None = None) -> DataFrame:
    """(key, term, n), and the kind if one is named: mentions of a lexicon's terms among the texts' word sequences, at each place the longest term.

    Terms may have any number of words. A term that lies inside a longer hit is
    not counted there. Words are runs of letters, digits and the marks of
    alleles and variants, in lower case. The lexicon, counted before, goes out
    as a trie of words that reads each text once and shuffles counts only; one
    beyond `mentions.SENT` characters is joined by runs of words.
    """
    named = [F.col(kind).alias("kind")] if kind else []
    own = lexicon.select(F.col(term).alias("term"), _term_words(F.col(term)).alias("_w"), *named).filter(F.size("_w") > 0)
    own = first_by(own.withColumn("_t", F.array_join("_w", " ")).drop("_w"), ["_t"], ["term", *(["kind"] if kind else [])])
    if (own.agg(F.sum(F.length("_t") + 16)).first()[0] or 0) > mentions.SENT:
        return lexicon_by_runs(texts, key, text, own, bool(kind))
    order = sorted(r[0] for r in own.select("_t").collect())
    hits = mentions.walked(texts, key, text, own, order).join(own, "_t")
    # rows that share a key are one text's mentions together
    return hits.groupBy(key, "term", *(["kind"] if kind else [])).agg(F.sum("n").alias("n"))


def lexicon_by_runs(texts: DataFrame, key: str, text: str, own: DataFrame, kind: bool) -> DataFrame:
    """lexicon_hits for a lexicon (term, _t, and a kind) of any size: all runs of as many words as terms have meet the terms in a join."""
    own = own.withColumn("_size", F.size(F.split("_t", " ")))
    sizes = sorted(r[0] for r in own.select("_size").distinct().collect())  # a number for each length of terms
    t = texts.select(key, _term_words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("_w", i + 1, n), " ").alias("t")))

    none = F.array().cast("array<struct<at:int,size:int,t:string>>")
    each = [F.when(F.size("_w") >= n, runs(n)).otherwise(none) for n in sizes] or [none]
    said = t.withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.explode(F.concat(*each)).alias("_r")).select(key, "_row", F.col("_r.at").alias("at"), F.col("_r.t").alias("_t"))
    hits = said.join(own, "_t").withColumn("_end", F.col("at") + F.col("_size"))
    # what starts before, or here and is longer, reaches beyond the end of what it holds
    before = Window.partitionBy(key, "_row").orderBy("at", F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    alone = hits.withColumn("_reach", F.max("_end").over(before)).filter(F.col("_reach").isNull() | (F.col("_end") > F.col("_reach")))
    return alone.groupBy(key, "term", *(["kind"] if kind else [])).agg(F.count("*").alias("n"))


def entity_lexicon(genes: DataFrame) -> DataFrame:
    """(term, kind) of a gene dictionary (symbol, ...): symbols with a digit, which running text does not hold by chance."""
    return genes.filter(F.col("symbol").rlike("[0-9]")).select(F.trim("symbol").alias("term"), F.lit("gene").alias("kind")).distinct()


def lexicon_kind(term: Column, kind: Column) -> Column:
    """The kind of a hit: what holds a `*` is an allele, an rs number a variant, else as the lexicon says."""
    return F.when(F.instr(term, "*") > 0, "alelo").when(term.rlike(r"(?i)^rs[0-9]+$"), "rsid").otherwise(kind)
