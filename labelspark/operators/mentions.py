"""Mentions of many names at once: an automaton or a trie of the whole vocabulary reads each text a single time.

A vocabulary is counted before it is sent. Up to SENT characters it goes to
every executor once, as a broadcast, and each worker builds its automaton once.
Larger vocabularies are cut into slices of that size by a hash of the name, and
the texts are read once for each slice (counts), or joined by their word runs
(longest terms, `matching.lexicon_by_runs`): the same rows, no name left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions import entities as ent

#: Characters of the names of one automaton; it takes some fifty times as many bytes in each worker.
SENT = 2_000_000
#: What a worker has built, under the broadcast's number: the last one only.
_BUILT: dict[int, object] = {}


def _built(number: int, names, build):
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = build(names.value)
    return _BUILT[number]


def _automaton(forms: list[tuple[str, bool]]):
    """Two automata, of the forms counted in canonical texts and of those counted in their own case; both give the form's number."""
    import ahocorasick

    out = []
    for own_case in (False, True):
        a = ahocorasick.Automaton()
        for k, (form, own) in enumerate(forms):
            if own == own_case:
                a.add_word(form, (k, len(form)))
        if len(a):
            a.make_automaton()
        out.append(a)
    return out


def bounded_hits(automaton, text: str, word=str.isalnum):
    """(number, start, end) of the occurrences that touch no letter or digit; those of one name do not overlap."""
    if not text or not len(automaton):
        return
    last: dict[int, int] = {}
    for at, (k, size) in automaton.iter(text):
        start, end = at + 1 - size, at + 1
        if start >= last.get(k, 0) and not (start and word(text[start - 1])) and not (end < len(text) and word(text[end])):
            last[k] = end
            yield k, start, end


def _whole_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _counted(number: int, sent, near: str, around: int):
    """(row, canonical, text) to (row, numbers, counts) of the forms found."""

    def run(batches):
        canonical, own_case = _built(number, sent, _automaton)
        vocabulary = re.compile(near)
        schema = pa.schema([("key", pa.binary()), ("forms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for b in batches:
            found = []
            for plain, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n: dict[int, int] = {}
                for k, _, _ in bounded_hits(canonical, plain):
                    n[k] = n.get(k, 0) + 1
                for k, start, end in bounded_hits(own_case, text, _whole_word):
                    if vocabulary.search(text[max(0, start - around) : end + around]):
                        n[k] = n.get(k, 0) + 1
                found.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array([list(n) for n in found], pa.list_(pa.int32())), pa.array([list(n.values()) for n in found], pa.list_(pa.int64()))], schema=schema)

    return run


def forms_of(name: Column, ambiguous: tuple[str, ...]) -> Column:
    """The spellings (form, own_case) under which a name is counted: an ambiguous symbol in its own case, an allele in all its spellings, else its key."""
    doubt = F.upper(F.trim(name)).isin(*ambiguous) if ambiguous else F.lit(False)
    plain = F.transform(ent.count_forms(name), lambda f: F.struct(f.alias("form"), F.lit(False).alias("own_case")))
    return F.when(doubt, F.array(F.struct(F.trim(name).alias("form"), F.lit(True).alias("own_case")))).otherwise(plain)


def mention_counts(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, ambiguous: tuple[str, ...] = ent.AMBIGUOUS, near: str = ent.GENETIC, around: int = ent.AROUND) -> DataFrame:
    """(key, name, form, n): how often each spelling of each name stands in each text between token bounds.

    A symbol that is also an ordinary word counts in its own case and only with
    the vocabulary `near` within `around` characters. Null and empty texts and
    names have no mentions; names that differ only in spelling of the same form
    each get its count. The key may have any type but a map's.
    """
    spark = texts.sparkSession
    wanted = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct().select("name", F.explode(forms_of(F.col("name"), ambiguous)).alias("f")).select("name", "f.form", "f.own_case").filter("form <> ''")
    forms = wanted.select("form", "own_case").distinct()
    chars = forms.agg(F.sum(F.length("form") + 16)).first()[0] or 0
    slices = max(1, -(-chars // SENT))
    # the key travels as bytes beside two forms of its text, which are read and not shuffled
    rows = texts.select(F.to_json(F.struct(F.col(key).alias("k"))).cast("binary").alias("key"), ent.counting_text(F.col(text)).alias("plain"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for s in range(slices):
        own = sorted((r.form, r.own_case) for r in forms.filter(F.pmod(F.xxhash64("form"), F.lit(slices)) == s).collect())
        sent = spark.sparkContext.broadcast(own)
        found = rows.mapInArrow(_counted(sent._jbroadcast.id(), sent, near, around), "key binary, forms array<int>, counts array<bigint>")
        numbers = spark.createDataFrame([(k, f, c) for k, (f, c) in enumerate(own)], "_k int, form string, own_case boolean")
        hits = found.select("key", F.explode(F.arrays_zip("forms", "counts")).alias("x")).select("key", F.col("x.forms").alias("_k"), F.col("x.counts").alias("n")).join(numbers, "_k").drop("_k")
        out = hits if out is None else out.unionByName(hits)
    kind = texts.schema[key].dataType.simpleString()
    named = out.join(wanted, ["form", "own_case"])
    return named.select(F.from_json(F.col("key").cast("string"), f"k {kind}")["k"].alias(key), "name", "form", "n")


_WORDS = re.compile(r"(?:[^\W_]|[*:\-])+")


def _trie(terms: list[tuple[str, ...]]) -> dict:
    """Words under words; the number of a term stands under the empty word."""
    root: dict = {}
    for k, words in enumerate(terms):
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node[""] = k
    return root


def longest(trie: dict, words: list[str]):
    """The numbers of the terms met, at each place the longest, without those that lie inside an earlier one."""
    reach = 0
    for at, first in enumerate(words):
        node, best, end, found = trie.get(first), None, at, None
        while node is not None:
            end += 1
            if "" in node:
                best, found = end, node[""]
            node = node.get(words[end]) if end < len(words) else None
        if found is not None and best > reach:
            reach = best
            yield found


def _walked(number: int, sent):
    """(..., text in lower case) to (..., numbers, counts)."""

    def run(batches):
        trie = _built(number, sent, _trie)
        for b in batches:
            found = []
            for text in b.column(b.num_columns - 1).to_pylist():
                n: dict[int, int] = {}
                for k in longest(trie, _WORDS.findall(text or "")):
                    n[k] = n.get(k, 0) + 1
                found.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([list(n) for n in found], pa.list_(pa.int32())), pa.array([list(n.values()) for n in found], pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "_terms", "_counts"])

    return run


def walked(texts: DataFrame, key: str, text: str, terms: DataFrame, order: list[str]) -> DataFrame:
    """(key, _t, n) for terms of which _t are the words, one blank apart; order: the distinct _t, as sent."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast([tuple(t.split(" ")) for t in order])
    rows = texts.select(key, F.lower(F.col(text)).alias("_text"))
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, _terms array<int>, _counts array<bigint>"
    found = rows.mapInArrow(_walked(sent._jbroadcast.id(), sent), schema)
    hits = found.select(key, F.explode(F.arrays_zip("_terms", "_counts")).alias("x")).select(key, F.col("x._terms").alias("_k"), F.col("x._counts").alias("_n"))
    numbers = spark.createDataFrame(list(enumerate(order)), "_k int, _t string")
    return hits.join(numbers, "_k").select(key, "_t", F.col("_n").alias("n"))
