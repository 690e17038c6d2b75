"""Active substances: splitting of combinations, query lists, and when two names match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import fold

# Pieces of a combination that name no substance.
STOP = (
    "analogues", "analogue", "analogs", "analog", "analogos", "analogo", "derivados", "derivado", "derivatives", "derivative",
    "outros", "outras", "other", "others", "associacoes", "associacao", "combinations", "combination",
    "etc", "e", "and", "ou", "or", "de", "da", "do", "e outros",
)

# Salts, counter-ions and other words that carry no match on their own.
GENERIC = (
    "acid", "acids", "acido", "acidos", "sodium", "sodio", "sodica", "sodico", "na",
    "potassium", "potassio", "potassica", "potassico", "k", "calcium", "calcio", "magnesium", "magnesio",
    "hydrochloride", "dihydrochloride", "hcl", "cloridrato", "dicloridrato", "chloride", "cloreto", "bromide", "brometo",
    "sulfate", "sulphate", "sulfato", "phosphate", "fosfato", "nitrate", "nitrato", "acetate", "acetato", "citrate", "citrato",
    "gluconate", "gluconato", "lactate", "lactato", "carbonate", "carbonato", "fumarate", "fumarato", "maleate", "maleato",
    "tartrate", "tartarato", "succinate", "succinato", "mesylate", "mesilato", "besylate", "besilato",
    "hydrate", "hidratado", "monohydrate", "dihydrate", "trihydrate", "anhydrous", "anidro", "salt", "sal", "hmg",
    "live", "viva", "attenuated", "atenuada", "strain", "estirpe", "vitamin", "vitamins", "vitamina", "vitaminas", "measurement",
)

# Substances that stand for each other, and the least length of a piece that may match.
EQUIVALENT = {"dexibuprofen": ("ibuprofen",), "acetylsalicylic acid": ("aspirin",), "ascorbic acid": ("vitamin c",), "metamizole": ("dipyrone",), "metamizol": ("dipyrone",)}
LEAST = 4

# What parts a combination, and stereochemical prefixes before which a name is another substance.
_SEPARATORS = r"(?iU)\s*(?:\+|/|;|,|\be\b|\band\b)\s*"
_STEREO = r"(?<!(?:\((?:s|r|\+|-)\)|\b(?:s|r|l|d))-\s{0,5})"


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_substances(text: Column, keep_whole: bool = True) -> Column:
    """The whole name first, then its parts: no stop or generic words, no short parts, no folded form twice."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    parts = F.transform(F.split(whole, _SEPARATORS), lambda x: F.trim(x))
    fine = F.filter(parts, lambda p: (F.length(fold(p)) >= LEAST) | (p == whole))
    every = F.concat(F.array(whole), fine) if keep_whole else fine
    return _distinct(F.filter(every, lambda p: (fold(p) != "") & ~F.array_contains(_list((*STOP, *GENERIC)), fold(p))))


def _distinct(values: Column) -> Column:
    """The first of each folded form, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(values, none, lambda out, v: F.when(F.exists(out, lambda o: fold(o) == fold(v)), out).otherwise(F.concat(out, F.array(v))))


def build_queries(substance: Column, aliases: Column, keep_whole: bool = True) -> Column:
    """What to look a substance up by: its aliases' parts before its own."""
    texts = F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array(F.coalesce(substance, F.lit(""))))
    return _distinct(F.flatten(F.transform(texts, lambda t: split_substances(t, keep_whole))))


def expanded(query: Column) -> Column:
    """A folded query and its equivalents, found by the whole query or a word of it."""
    out = F.array(query)
    for key, others in EQUIVALENT.items():
        out = F.concat(out, F.when(query.rlike(rf"\b{key}\b"), _list(others)).otherwise(F.array().cast("array<string>")))
    return out


def _within(shorter: Column, longer: Column) -> Column:
    carries = (F.length(shorter) >= LEAST) & ~shorter.isin(*GENERIC)
    return carries & F.regexp_like(longer, F.concat(F.lit(_STEREO + r"\b\Q"), shorter, F.lit(r"\E\b")))


def same_substance(value: Column, query: Column) -> Column:
    """Whether two folded names match: equal, or the shorter a whole word of the longer that is more than a salt, a fragment or a stereoisomer's stem."""
    shorter = F.when(F.length(query) <= F.length(value), query).otherwise(value)
    longer = F.when(F.length(query) <= F.length(value), value).otherwise(query)
    return (value != "") & (query != "") & ((value == query) | _within(shorter, longer))


def matches(value: Column, query: Column) -> Column:
    """same_substance of any names, equivalents included."""
    v, q = fold(value), fold(query)
    return (q != "") & F.exists(expanded(q), lambda c: same_substance(v, c))
