"""Groups of identical documents, their representatives, and what is inherited through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.functions.text import fold_alnum
from labelspark.operators.matching import first_by

# Names of generics' makers.
GENERIC_MAKERS = (
    r"(?i)\b(generis|ratiopharm|krka|sandoz|teva|viatris|mylan|zentiva|aurovitas|pharmakern|bluepharma|azevedos|labesfal|ciclum|farmoz|"
    r"tecnimede|medinfar|accord|stada|normon|kern|cinfa|towa|alter|pentafarma|aristo|jaba)\b"
)


def is_generic(maker: Column) -> Column:
    return F.coalesce(maker, F.lit("")).rlike(GENERIC_MAKERS)


def representatives(docs: DataFrame, group: str = "hash") -> DataFrame:
    """Of each group of (file, name, maker, `group`) the row that stands for it: no generic maker if possible, then name, then file."""
    return first_by(docs, [group], [is_generic(F.col("maker")), fold_alnum(F.col("name")), "file"])


def duplicate_map(docs: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """(key, representative, group) of every document that another one of its group stands for.

    Representatives are aggregated before they are joined back, so a group that holds a large share of all documents is no single task.
    """
    first = docs.groupBy(group).agg(F.min_by(key, F.struct(*order)).alias("representative"))
    return docs.join(first, group).filter(F.col(key) != F.col("representative")).select(key, "representative", group)


def propagate(results: DataFrame, mapped: DataFrame, key: str, force: bool = False) -> DataFrame:
    """results and, for each (key, representative), the representative's rows under the key, marked with their origin; rows that are there already stay unless forced."""
    own = [c for c in results.columns if c != key]
    copies = mapped.select(F.col(key).alias("_to"), "representative").join(results, F.col("representative") == F.col(key))
    copies = copies.select(F.col("_to").alias(key), *own, F.col("representative").alias("resultado_propagado_de"))
    if force:
        results = results.join(copies.select(key), key, "left_anti")
    else:
        copies = copies.join(results.select(key), key, "left_anti")
    return results.withColumn("resultado_propagado_de", F.lit(None).cast(dict(copies.dtypes)["resultado_propagado_de"])).unionByName(copies)


def unresolved(results: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Duplicates whose representative has no result."""
    return mapped.join(results.select(F.col(key).alias("representative")), "representative", "left_anti")


def join_by_name_or_id(files: DataFrame, file: str, register: DataFrame, name: str, id_: str, pattern: str = r"(?:^|_)(\d{3,7})_", keep: str = "last", pos: str | None = None) -> DataFrame:
    """files with the register's row of the same name, else of the number in the file's name. keep: which row of a repeated id counts."""
    order = [F.desc(pos) if keep == "last" else pos] if pos else [id_]
    more = [c for c in register.columns]
    by_name = first_by(register.filter(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""), [name], order)
    by_id = first_by(register.filter(F.col(id_).isNotNull()), [id_], order)
    left = files.withColumn("_id", F.regexp_extract(file, pattern, 1))
    a = by_name.select(F.col(name).alias("_name"), F.struct(*more).alias("_a"))
    b = by_id.select(F.col(id_).cast("string").alias("_key"), F.struct(*more).alias("_b"))
    both = left.join(a, F.col(file) == F.col("_name"), "left").join(b, F.col("_id") == F.col("_key"), "left")
    return both.select(*files.columns, F.coalesce("_a", "_b").alias("register"), F.when(F.col("_a").isNotNull(), "nome").when(F.col("_b").isNotNull(), "id").alias("via"))


def one_per_compound(docs: DataFrame, compound: str, order: list) -> DataFrame:
    """One document of each compound: usable, of one substance, the longest, then by name, as `order` says."""
    return first_by(docs, [compound], order)


def orphan_groups(docs: DataFrame, group: str, key: str, registered: DataFrame) -> DataFrame:
    """Per group: documents, those not registered, and whether all or some are; for mixed groups the registered document that may stand for it."""
    known = registered.select(F.col(key)).distinct().withColumn("_in", F.lit(True))
    d = docs.join(known, key, "left").withColumn("_orphan", F.col("_in").isNull())
    return d.groupBy(group).agg(
        F.count("*").alias("n_docs"), F.count_if("_orphan").alias("n_orphans"),
        F.when(F.bool_and("_orphan"), "todos").when(F.bool_or("_orphan"), "misto").otherwise("nenhum").alias("kind"),
        F.when(F.bool_or("_orphan"), F.min(F.when(~F.col("_orphan"), F.col(key)))).alias("replacement"),
    )


def scenario(docs: DataFrame, key: str, name: str, excluded: DataFrame, replaced: DataFrame) -> DataFrame:
    """The corpus as it is (`atual`), or (`B`) without excluded documents and with replaced representatives."""
    if name == "atual":
        return docs
    out = docs.join(excluded.select(key), key, "left_anti").join(replaced.select(F.col("old").alias("representative"), "new"), "representative", "left")
    return out.withColumn("representative", F.coalesce("new", "representative")).drop("new").select(docs.columns)


def rebuilt_map(docs: DataFrame, mapped: DataFrame, key: str, group: str) -> DataFrame:
    """Each document's representative: as mapped, else another document of the same group, else null."""
    by_group = docs.groupBy(group).agg(F.min(key).alias("_g"), F.count("*").alias("_n"))
    out = docs.join(mapped.select(key, "representative"), key, "left").join(by_group, group, "left")
    return out.select(key, F.coalesce("representative", F.when(F.col("_n") > 1, F.col("_g"))).alias("representative"))


def holder_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How many pairs name the same holder, a different one, or miss one."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    kind = F.when(blank(a) | blank(b), "em falta").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "igual").otherwise("diferente")
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def lots(df: DataFrame, n: int, order: str, slices: int | None = None) -> DataFrame:
    """df with lot (from 0): n contiguous slices of equal size by a numeric column, the last one shorter; rows without it come first.

    Quantiles of the column, one for each shuffle partition, cut it into ranges
    of about equal size, whether its values are dense or sparse; rows are
    numbered inside ranges and the ranges' counts are summed up, so no task
    orders all rows and none sees more counts than there are ranges. Rows
    without a value have no order and are dealt into as many ranges by their hash.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [k / slices for k in range(1, slices)], 10 * slices)).first()[0] if slices > 1 else None
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<double>")
    dealt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.lit(slices)).cast("int") - slices
    b = F.when(F.col(order).isNull(), dealt).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(order))))
    counts = df.groupBy(b.alias("_b")).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c")).first()[0] or 0
    size = max(1, -(-total // n))
    starts = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(order)
    out = df.withColumn("_b", b).withColumn("_r", F.row_number().over(inside)).join(F.broadcast(starts), "_b")  # a row for each range
    return out.withColumn("lot", F.floor((F.col("_start") + F.col("_r") - 1) / F.lit(size)).cast("long")).drop("_b", "_r", "_start")


def longest_version(df: DataFrame, keys: list[str], text: str, pos: str) -> DataFrame:
    """Of each key's texts the longest, of equally long ones the first, of those in one place the least."""
    return first_by(df, keys, [F.desc(F.length(text)), pos, text])


def ordered_distinct(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return first_by(df, keys, order)
