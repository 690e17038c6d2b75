"""How far labels of one group, or runs over one corpus, agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.functions.text import percent


def identical_pairs(texts: DataFrame, group: str, section: str, hash_: str) -> DataFrame:
    """Per section, over groups of at least two documents: groups, uniform groups, pairs, identical pairs and their ratio.

    Identical pairs come from the sizes of equal texts; no pair is ever made.
    """
    same = texts.groupBy(group, section, hash_).agg(F.count("*").alias("x"))
    by = same.groupBy(group, section).agg(F.sum("x").alias("n"), F.count("*").alias("d"), F.sum(F.col("x") * (F.col("x") - 1) / 2).alias("i")).filter("n >= 2")
    out = by.groupBy(section).agg(F.count("*").alias("n_groups"), F.count_if(F.col("d") == 1).alias("n_uniform"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), F.sum("i").cast("long").alias("n_identical"))
    return out.withColumn("pct_identical", percent(F.col("n_identical"), F.col("n_pairs")))


def flag_agreement(flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Per key: documents, and whether the flag is on for all, some or none."""
    f = F.col(flag)
    kind = F.when(F.bool_and(f), "todos").when(F.bool_or(f), "misto").otherwise("nenhum")
    return flags.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.count_if(f).alias("n_true"), kind.alias("agreement"))


def signatures(texts: DataFrame, doc: str, pos: str, hash_: str) -> DataFrame:
    """(doc, signature): the hashes of a document's sections in order, as one value."""
    return texts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, hash_))), lambda x: x[hash_]), "|").alias("signature"))


def collapse(signed: DataFrame) -> DataFrame:
    """Documents, distinct signatures, and how many documents fall together."""
    return signed.agg(F.count("*").alias("n_docs"), F.count_distinct("signature").alias("n_distinct")).withColumn("n_collapsed", F.col("n_docs") - F.col("n_distinct"))


def profile_equality(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per substance of (doc, substance): documents and distinct sets of (section, kind, value); a document without items has the empty set."""
    sets = items.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("section", "kind", "value"))).alias("p"))
    by = docs.join(sets, "doc", "left").groupBy("substance").agg(F.count_distinct("doc").alias("n_docs"), F.count_distinct(F.coalesce(F.to_json("p"), F.lit("[]"))).alias("n_profiles"))
    return by.withColumn("uniform", F.col("n_profiles") == 1)


def heading_forms(headings: DataFrame, key: str, form: str) -> DataFrame:
    """Per key: headings, distinct forms, forms used once, and the share of the most used one."""
    by = headings.groupBy(key, form).agg(F.count("*").alias("n"))
    out = by.groupBy(key).agg(F.sum("n").alias("n_headings"), F.count("*").alias("n_forms"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("_top"))
    return out.withColumn("pct_dominant", percent(F.col("_top"), F.col("n_headings"))).drop("_top")


def forms_per_symbol(items: DataFrame, symbol: str, form: str) -> DataFrame:
    """Per symbol: its spellings, distinct but for case, and mentions."""
    return items.groupBy(symbol).agg(F.count_distinct(F.lower(form)).alias("n_forms"), F.count("*").alias("n_mentions"))


def only_expanded(values: DataFrame, known: DataFrame, doc: str, value: str) -> DataFrame:
    """Documents all of whose values are in the known set."""
    outside = values.join(known.select(value), value, "left_anti").select(doc).distinct()
    return values.select(doc).distinct().join(outside, doc, "left_anti")


def group_codes(docs: DataFrame, code: str, label: str) -> DataFrame:
    """Per first level of a group code: codes, labels, documents, and the most labels that one code has."""
    by = docs.filter(F.col(code).isNotNull()).groupBy(F.split_part(F.col(code), F.lit("."), F.lit(1)).alias("level"), code).agg(F.count_distinct(label).alias("l"), F.count("*").alias("n"))
    return by.groupBy("level").agg(F.count("*").alias("n_codes"), F.sum("l").alias("n_labels"), F.sum("n").alias("n_docs"), F.max("l").alias("most_labels"))


def pattern_documents(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row: how many documents hold each pattern."""
    return docs.agg(*[F.count_if(F.col(text).rlike(p)).alias(k) for k, p in patterns.items()])


def texts_per_group(docs: DataFrame, key: str, representative: str, cap: int = 13) -> DataFrame:
    """Histogram of the distinct texts a group has, the last bar for `cap` and more: groups and documents."""
    by = docs.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(representative).alias("d"))
    return by.groupBy(F.least("d", F.lit(cap)).alias("n_texts")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_docs"))


def run_agreement(runs: DataFrame, raw: str, entities: str) -> DataFrame:
    """Over documents that every run of (run, doc, raw, entities) has: how many there are, and how many have identical raw output and identical entities."""
    total = runs.agg(F.count_distinct("run").alias("_runs"))
    by = runs.groupBy("doc").agg(F.count_distinct("run").alias("r"), F.count_distinct(raw).alias("a"), F.count_distinct(entities).alias("e")).crossJoin(total).filter("r = _runs")
    out = by.agg(F.count("*").alias("n_docs"), F.count_if(F.col("a") == 1).alias("n_raw"), F.count_if(F.col("e") == 1).alias("n_entities"))
    return out.withColumns({"tar_raw": percent(F.col("n_raw"), F.col("n_docs")), "tar_entities": percent(F.col("n_entities"), F.col("n_docs"))})


def diverging(runs: DataFrame, raw: str, first: int = 3) -> DataFrame:
    """Documents whose sections differ between runs of (run, doc, section, raw), with the first sections that do."""
    total = runs.agg(F.count_distinct("run").alias("_runs"))
    by = runs.groupBy("doc", "section").agg(F.count_distinct(raw).alias("d"), F.count_distinct("run").alias("r")).crossJoin(total).filter("d > 1 or r < _runs")
    return by.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("section")), 1, first).alias("sections"), F.count("*").alias("n_sections"))


def confusion(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, found, right, missed and invented entities."""
    g, f = gold.select(*keys).distinct().withColumn("_g", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = g.join(f, keys, "full")
    n = lambda c: F.count_if(c).cast("long")
    return both.agg(n(F.col("_g") == 1).alias("expected"), n(F.col("_f") == 1).alias("found"), n((F.col("_g") == 1) & (F.col("_f") == 1)).alias("right"), n((F.col("_g") == 1) & F.col("_f").isNull()).alias("missed"), n(F.col("_g").isNull() & (F.col("_f") == 1)).alias("invented"))


def order_statistics(values: DataFrame, key: str, value: str, buckets: int = 4096) -> DataFrame:
    """Per key the elements at n div 4, n div 2 and 3n div 4 (from 0) of the sorted values, and the median. Exact.

    Buckets of equal width cut each key's range of numbers, counts say which
    bucket holds a wanted element, and only those few buckets' distinct values
    are sorted: no key is sorted as a whole, however many rows it has.
    """
    v = values.select(key, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    cuts = v.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("n"))
    width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low"))
    bucket = F.coalesce(F.floor((F.col("_v") - F.col("_low")) / width * (buckets - 1)), F.lit(0))
    same = v.groupBy(key, "_v").agg(F.count("*").alias("_c")).join(cuts.drop("n"), key).select(key, bucket.alias("_b"), "_v", "_c")
    per = same.groupBy(key, "_b").agg(F.sum("_c").alias("_c")).withColumn("_hi", F.sum("_c").over(Window.partitionBy(key).orderBy("_b")))
    n = F.col("n")
    places = {"q1": F.floor(n / 4), "middle": F.floor(n / 2), "q3": F.floor(3 * n / 4), "lower": F.floor((n - 1) / 2)}
    asked = cuts.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("what"), p.alias("at")) for k, p in places.items()])).alias("p")).select(key, "p.what", "p.at")
    where = asked.join(per, key).filter((F.col("at") < F.col("_hi")) & (F.col("at") >= F.col("_hi") - F.col("_c"))).select(key, "_b", "what", (F.col("at") - F.col("_hi") + F.col("_c")).alias("at"))
    few = same.join(where.select(key, "_b").distinct(), [key, "_b"], "left_semi").withColumn("_hi", F.sum("_c").over(Window.partitionBy(key, "_b").orderBy("_v")))
    found = few.join(where, [key, "_b"]).filter((F.col("at") < F.col("_hi")) & (F.col("at") >= F.col("_hi") - F.col("_c")))
    of = lambda k: F.max(F.when(F.col("what") == k, F.col("_v")))
    out = found.groupBy(key).agg(of("q1").alias("q1"), of("middle").alias("middle"), of("q3").alias("q3"), ((of("lower") + of("middle")) / 2).alias("median"))
    return cuts.select(key, "n").join(out, key)


def seeded_sample(groups: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n keys of the least seeded hashes, the same at every run."""
    return groups.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def two_of_each(docs: DataFrame, sampled: DataFrame, key: str, doc: str, seed: int) -> DataFrame:
    """Two documents of each sampled key, by seeded hash."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.col(doc)), doc)
    return docs.join(sampled, key).withColumn("nth", F.row_number().over(w)).filter("nth <= 2")


def association_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose sets of values changed: what went and what came, sorted."""
    a = old.select(key, value).distinct().withColumn("_o", F.lit(True))
    b = new.select(key, value).distinct().withColumn("_n", F.lit(True))
    both = a.join(b, [key, value], "full")
    gone, come = F.col("_o") & F.col("_n").isNull(), F.col("_o").isNull() & F.col("_n")
    out = both.groupBy(key).agg(F.array_sort(F.collect_list(F.when(gone, F.col(value)))).alias("removed"), F.array_sort(F.collect_list(F.when(come, F.col(value)))).alias("added"))
    return out.filter((F.size("removed") > 0) | (F.size("added") > 0))


def pruned(values: Column, valid: Column) -> Column:
    """An array without what is no longer valid."""
    return F.filter(values, lambda x: F.array_contains(valid, x))


def distinct_forms(rows: DataFrame, value: str, folded: Column, pos: str) -> DataFrame:
    """The first spelling of each folded value, and how many rows it stands for."""
    return rows.groupBy(folded.alias("folded")).agg(F.min_by(value, pos).alias(value), F.count("*").alias("n"))
