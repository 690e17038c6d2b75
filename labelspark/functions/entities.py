"""Alleles, diplotypes, genes: canonical forms, classes and bounded counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.text import plain_dashes, squeeze

# Gene symbols that are also Portuguese words or abbreviations.
AMBIGUOUS = (
    "POR", "ADO", "AR", "ADA", "INA", "DES", "PELO", "ICOS", "TES", "TAT", "MIA", "MICA", "PAM", "GEM", "GAL",
    "MAL", "SMO", "MOS", "SI", "MAX", "HAL", "TRA", "LIAS", "TRO", "LTA", "RIDA", "CRIPT", "RARA", "DERA",
)

# Vocabulary that shows that a mention is genetic, and how far around a mention it may stand.
GENETIC = (
    r"(?i)\b(gene|genes|gen[ée]tic\w*|gen[óo]tipo\w*|genotip\w*|alelo\w*|polimorf\w*|variante\w*|muta[çc]\w*|"
    r"hapl[óo]tipo\w*|dipl[óo]tipo\w*|enzim\w*|isoenzim\w*|metaboliz\w*|expressão\s+g[ée]nica|farmacogen\w*|"
    r"codifica\w*|cromossom\w*|CYP\d[A-Z]\d+|transportador\w*|recetor\w*\s+g[ée]nic\w*|deficiência\s+de)\b"
)
AROUND = 160

# Ordered classes of an allele's or a diplotype's form; the first pattern that fits names it.
ALLELE_FORMS = (
    (r"(?i)C\.\d+", "variante HGVS, nao alelo"),
    (r"^[A-Z0-9]+\*[A-Z]$", "letra em vez de numero (invalido)"),
    (r"^HLA-[A-Z]+\*\d+:\d+$", "HLA com dois pontos (forma actual)"),
    (r"^HLA-[A-Z]+\*\d{4,}$", "HLA sem dois pontos (forma antiga)"),
    (r"^HLA-[A-Z]+\*\d{1,2}$", "HLA incompleto (serotipo)"),
    (r"^[A-Z0-9]+\*\d+[A-Z]?$", "alelo estrela valido"),
)
DIPLOTYPE_FORMS = (
    (r"C\.\d+", "genotipo em HGVS (c.NNN + bases)"),
    (r"^[ACGT]{2}$", "bases soltas, sem gene"),
    (r"^[A-Z0-9]+\*[A-Z]\*[A-Z]$", "improvisacao (*base*base)"),
    (r"^[A-Z0-9]+[ACGT]{2}$", "gene + bases (sem c.)"),
    (r"^[A-Z0-9]+\*\d+[A-Z]?\*\d+[A-Z]?$", "diplotipo valido"),
)


def _first_form(c: Column, forms) -> Column:
    out = F.when(c.rlike(forms[0][0]), forms[0][1])
    for pattern, name in forms[1:]:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("outro")


def allele_form(c: Column) -> Column:
    return _first_form(c, ALLELE_FORMS)


def diplotype_form(c: Column) -> Column:
    return _first_form(F.upper(c), DIPLOTYPE_FORMS)


def is_diplotype(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit(""))) > 1


def canonical_hla(c: Column) -> Column:
    """Four digits after an HLA locus become two and two; nothing else changes."""
    parts = r"^(?i)(HLA-[A-Z]+\d*)\*(\d{2})(\d{2})$"
    return F.when(c.rlike(parts), F.concat(F.upper(F.regexp_extract(c, parts, 1)), F.lit("*"), F.regexp_extract(c, parts, 2), F.lit(":"), F.regexp_extract(c, parts, 3))).otherwise(c)


def entity_key(c: Column) -> Column:
    """Upper case, plain dashes, no white space, no edge punctuation."""
    return F.regexp_replace(F.upper(F.regexp_replace(plain_dashes(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")), r"^[ ;,.]+|[ ;,.]+$", "")


def star_allele(c: Column) -> Column:
    """entity_key with the hyphen that an HLA locus lost."""
    return F.regexp_replace(F.replace(entity_key(c), F.lit("HLA_"), F.lit("HLA-")), r"^HLA(?!-)([^*]+)\*", "HLA-$1*")


def gene_of(c: Column) -> Column:
    """What stands before `*`, before an HGVS position or before two final bases; else null."""
    v = F.trim(F.coalesce(c, F.lit("")))
    none = lambda x: F.when(x != "", x)
    hgvs = F.regexp_extract(v, r"^(?i)([A-Z][A-Z0-9-]{2,})c\.\d+", 1)
    bases = F.regexp_extract(v, r"^(?i)([A-Z][A-Z0-9-]{2,}?)[ACGT]{2}$", 1)
    return F.when(v.contains("*"), none(F.upper(F.split_part(v, F.lit("*"), F.lit(1))))).otherwise(F.upper(F.coalesce(none(hgvs), none(bases))))


def counting_text(c: Column) -> Column:
    """The form in which mentions are counted: upper case, plain dashes, no space around `*` and `-`."""
    return F.trim(F.upper(F.regexp_replace(squeeze(plain_dashes(F.coalesce(c, F.lit("")))), r"\s*([*\-])\s*", "$1")))


def bounded_count(canonical: Column, needle: Column) -> Column:
    """Occurrences of needle that touch no letter or digit."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), needle, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.when(needle != "", F.regexp_count(canonical, quoted)).otherwise(0)


def count_forms(variant: Column) -> Column:
    """The spellings of one allele: as it is and, for HLA, without the hyphen and with a space for it."""
    c = star_allele(variant)
    rest = F.substring(c, 5, 1_000)
    hla = F.array(c, F.concat(F.lit("HLA"), rest), F.concat(F.lit("HLA "), rest))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.when(c.startswith("HLA-") & c.contains("*"), hla).otherwise(F.array(c))))


def allele_count(variant: Column, text: Column) -> Column:
    """Mentions of an allele in all its spellings."""
    body = counting_text(text)
    return F.aggregate(F.transform(count_forms(variant), lambda f: bounded_count(body, f)), F.lit(0), lambda a, x: a + x)


@F.pandas_udf(T.LongType())
def ambiguous_count(text: pd.Series, symbol: pd.Series) -> pd.Series:
    """Mentions of a symbol in its own case with genetic vocabulary around them."""
    near = re.compile(GENETIC)

    def one(t, s):
        if not t or not s:
            return 0
        return sum(bool(near.search(t[max(0, m.start() - AROUND) : m.end() + AROUND])) for m in re.finditer(rf"\b{re.escape(s)}\b", t))

    return pd.Series([one(t, s) for t, s in zip(text, symbol, strict=True)], dtype="int64")


def mention_count(text: Column, symbol: Column) -> Column:
    """ambiguous_count for ambiguous symbols, bounded_count for all others."""
    return F.when(F.upper(symbol).isin(*AMBIGUOUS), ambiguous_count(text, symbol)).otherwise(bounded_count(counting_text(text), entity_key(symbol)).cast("long"))
