"""How faithfully an excerpt repeats its block, and JSON out of model answers."""

from __future__ import annotations

import bisect
import html
import json
import os
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.text import DASHES

# The share of an excerpt that must be in the block, the least fragment that counts, invisible characters.
COVERAGE, FRAGMENT, INVISIBLE = 0.85, 20, "­​‌‍﻿"

#: Excerpts of one unit that a task grades.
PIECE = 20_000


_MARKS = {**dict.fromkeys(map(ord, INVISIBLE)), **dict.fromkeys(map(ord, DASHES), "-")}


def comparable(text: str | None) -> str:
    text = html.unescape(text or "")
    if not text.isascii():  # nothing to compose, no mark and no other dash in ASCII
        text = unicodedata.normalize("NFKC", text).translate(_MARKS)
    if "-" in text:
        text = re.sub(r"\s*-\s*", "", text)
    return " ".join(text.split()).lower()


class Block:
    """A text made comparable once for all its excerpts, with the order of its suffixes as soon as an excerpt needs it."""

    def __init__(self, text: str | None):
        self.text, self.order = comparable(text), None

    def _suffixes(self) -> np.ndarray:
        """Where the suffixes begin, in order: ranked by 1, 2, 4 ... characters until no two are alike."""
        rank = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        step = 1
        while True:
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            order = np.lexsort((after, rank))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
            rank[order] = np.cumsum(fresh)
            step *= 2
            if fresh.all() or step >= len(rank):
                return order

    def longest_prefix(self, rest: str) -> int:
        """How many first characters of rest the text holds in one piece: as many as rest shares with one of the suffixes it would stand between."""
        if self.order is None:
            self.order = self._suffixes()
        at = bisect.bisect_left(self.order, rest, key=lambda k: self.text[k : k + len(rest)])
        near = (int(k) for k in self.order[max(at - 1, 0) : at + 1])
        return max(len(os.path.commonprefix((rest, self.text[k : k + len(rest)]))) for k in near)

    def state(self, excerpt: str | None) -> str:
        """verbatim, recomposto (nearly all of it in pieces that are long enough) or nao_encontrado."""
        rest = comparable(excerpt)
        if not rest or not self.text:
            return "nao_encontrado"
        if rest in self.text:
            return "verbatim"
        size, found = len(rest), 0
        while len(rest) >= FRAGMENT and rest[:FRAGMENT] in self.text:  # most excerpts of other texts need no order of suffixes
            n = self.longest_prefix(rest)
            found, rest = found + n, rest[n:].lstrip()
        return "recomposto" if found / size >= COVERAGE else "nao_encontrado"


@F.pandas_udf(T.StringType())
def fidelity(excerpt: pd.Series, block: pd.Series) -> pd.Series:
    """verbatim, recomposto (in pieces) or nao_encontrado."""
    return pd.Series([Block(b).state(e) for e, b in zip(excerpt, block, strict=True)], dtype=object)


def graded(units: DataFrame, excerpts: DataFrame, on: list[str], text: str = "texto", excerpt: str = "texto_original") -> DataFrame:
    """The excerpts whose unit is there, with `fidelidade` to it. A unit is made comparable and indexed once, not once for each excerpt.

    Units and excerpts are sorted together, each unit before its excerpts, so
    a task holds one unit at a time. A unit of more than PIECE excerpts goes
    to several tasks. Null keys meet nothing; of units with one key the last
    text counts; null texts are empty and an empty excerpt is nowhere. Other columns of
    the excerpts, of any type, stay as they are.
    """
    if {"_unit", "_piece", "fidelidade"} & set(excerpts.columns):
        raise ValueError("_unit, _piece and fidelidade are columns of the result or on the way to it")
    keys = [F.col(f"`{c}`") for c in on]
    names, there = excerpts.columns, F.lit(True)
    hashed = [F.col(f"`{f.name}`") for f in excerpts.schema if f.dataType.typeName() not in ("map", "variant")]
    for k in keys:
        there = there & k.isNotNull()
    many = excerpts.filter(there).groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_n")).filter("_n > 1")
    many = F.broadcast(many)  # one row for more than PIECE excerpts
    pieces = F.coalesce("_n", F.lit(1))
    e = excerpts.filter(there).join(many, on, "left").withColumn("_piece", F.pmod(F.xxhash64(*hashed), pieces).cast("int")).drop("_n")
    u = units.filter(there).select(*keys, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_unit")).join(many, on, "left")
    u = u.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_n")
    both = e.withColumn("_unit", F.lit(None).cast("string")).unionByName(u, allowMissingColumns=True)
    both = both.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", F.col("_unit").asc_nulls_last())
    schema = T.StructType([*excerpts.schema.fields, T.StructField("fidelidade", T.StringType())])

    def grade(batches):
        block, key = Block(None), None
        for batch in batches:
            marks = list(zip(*[batch[c].to_pylist() for c in (*on, "_piece")], strict=True))
            keep, states = [], []
            for row, (mark, unit, said) in enumerate(zip(marks, batch["_unit"].to_pylist(), batch[excerpt].to_pylist(), strict=True)):
                if unit is not None:
                    block, key = Block(unit), mark
                elif mark == key:
                    keep.append(row)
                    states.append(block.state(said))
            out = batch.select(names).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(states, pa.string())], names=[*names, "fidelidade"])

    return both.mapInArrow(grade, schema)


def evaluated(units: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Per section of units (section, unit, origem, texto) and excerpts (section, unit, pos, texto_original): trusted text and counts by fidelity."""
    both = graded(units, excerpts, ["section", "unit"]).join(units.select("section", "unit", "origem"), ["section", "unit"])
    trusted = F.col("fidelidade") != "nao_encontrado"
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("unit", "pos", "texto_original")))), lambda x: x["texto_original"]), "\n\n")
    return both.groupBy("section").agg(
        text(trusted).alias("texto_para_entidades"),
        text(trusted & (F.col("origem") == "content")).alias("texto_de_content"),
        text(trusted & (F.col("origem") != "content")).alias("texto_de_tabelas"),
        *[F.count_if(F.col("fidelidade") == s).cast("long").alias(f"n_{s}") for s in ("verbatim", "recomposto", "nao_encontrado")],
    )


def _spans(text: str, open_: str, close: str):
    depth = start = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|' + f"[{re.escape(open_ + close)}]", text, re.S):
        if m[0] == open_:
            start = start if depth else m.start()
            depth += 1
        elif m[0] == close and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def _candidates(text: str):
    yield text
    if fence := re.search(r"```(?:json)?\s*(.+?)\s*```", text, re.S):
        yield fence[1]
    for pair in ("{}", "[]"):
        yield from _spans(text, *pair)


def _salvage(text: str | None) -> str | None:
    for part in _candidates((text or "").strip()):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def salvaged_json(text: pd.Series) -> pd.Series:
    """The first JSON of a model's answer: all of it, a fenced block, or a balanced span; else null."""
    return pd.Series([_salvage(t) for t in text], dtype=object)


def _parsed(text: str | None) -> tuple | None:
    """The JSON value of a text, in a tuple; None where it has none."""
    try:
        return None if text is None else (json.loads(text),)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def without_paths(text: pd.Series) -> pd.Series:
    """JSON without any key that ends in `path`; null where the text is no JSON."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if not k.lower().endswith("path")}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return pd.Series([None if (x := _parsed(t)) is None else json.dumps(strip(x[0]), ensure_ascii=False) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    """All strings inside a JSON value; none where the text is no JSON."""

    def walk(x):
        if isinstance(x, str):
            yield x
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(v)

    return pd.Series([[] if (x := _parsed(t)) is None else list(walk(x[0])) for t in text], dtype=object)


# Fixed value: the shape of one item of a model's answer.
ITEM = "struct<symbol:string,variant:string,entity:string,rsid:string,gene:string,genes:array<string>,raw_text:string,reason:string,total_mentions:int>"


def model_items(answers: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """(key, kind, value, gene, mentions, complete) of a list of items, each a string or an object, under `kind` of a JSON object."""
    raw = F.from_json(F.get_json_object(F.col(column), f"$.{kind}"), "array<string>")
    rows = answers.select(key, F.posexplode(raw).alias("pos", "item"))
    one = F.from_json("item", ITEM, {"mode": "PERMISSIVE"})
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    value = F.when(F.col("item").startswith("{"), F.coalesce(*[none(one[f]) for f in ("entity", "variant", "symbol", "rsid")])).otherwise(none(F.col("item")))
    rows = rows.select(key, "pos", value.alias("value"), one["gene"].alias("gene"), F.greatest(F.coalesce(one["total_mentions"], F.lit(1)), F.lit(1)).alias("mentions")).filter("value is not null")
    complete = F.lit(True) if kind == "genes" else F.col("value").rlike(r"(?i)^rs\d+$") if kind == "rsids" else F.col("value").rlike(r"^[^*]+\*.+$")
    return rows.select(key, F.lit(kind).alias("kind"), "pos", "value", "gene", "mentions", complete.alias("complete"))


def error_label(status: Column, message: Column) -> Column:
    """The kind of a failed model call."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 429) | text.contains("rate limit"), "limite_de_pedidos")
        .when(status.isin(502, 503, 504), "servidor_indisponivel")
        .when(text.contains("timeout") | text.contains("timed out"), "tempo_esgotado")
        .when(text.contains("connection"), "ligacao_falhou")
        .otherwise("erro_desconhecido")
    )
