"""URL filters: longest host and path rule first, then a weighted vocabulary found by Aho-Corasick.

A term counts only between boundaries: the ends of the url, anything but an
ASCII letter or digit, or, before it, a percent-encoded byte. A url that no rule
decides is blocked when the weights of its distinct terms add up to the limit:
a strict term weighs as much as the limit, so one is enough, a soft term less.
The vocabulary is a table (term, weight) of any size up to MOST_TERMS, more are
an error; the default has strict terms of weight 2, soft ones of 1, limit 2.

Defined results: a null url, or one without `://`, has an empty host and path,
fits no rule, and is judged by the vocabulary alone (null: allow); repeated
rows each come out; an empty table gives an empty table; columns beside page_id
and url are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import bound_batches

#: (host, path, verdict): a rule fits its host and all subdomains, and paths that start with its own.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("porn", "porno", "xxx", "hentai", "nsfw", "camgirls", "escorts", "viagra", "warez", "keygen")
SOFT = ("adult", "sex", "nude", "erotic", "casino", "poker", "betting", "pills", "crack", "torrent", "dating", "payday", "hack", "free-money")
SOFT_LIMIT = 2
#: A vocabulary goes to every worker: the most terms it may have, each of at most TERM_CHARS characters.
MOST_TERMS, TERM_CHARS = 200_000, 256
_UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


@lru_cache(maxsize=8)
def _by_host(rules: tuple) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        out.setdefault(host, []).append((path, verdict))
    return out


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule that fits, and its verdict; block wins between rules of the same text. Only rules of the host and its parents are looked at."""
    known, fits, own = _by_host(tuple(rules)), [], host
    while True:
        fits += [(len(own) + len(p), v == "block", own + p, v) for p, v in known.get(own, ()) if path.startswith(p)]
        if "." not in own:
            return max(fits)[2:] if fits else None
        own = own.partition(".")[2]


def default_terms(strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT) -> dict[str, float]:
    return {**dict.fromkeys(soft, 1.0), **dict.fromkeys(strict, float(limit))}


def read_terms(table: DataFrame, most: int = MOST_TERMS) -> dict[str, float]:
    """The vocabulary of a table (term, weight): terms without blanks at their ends and with A-Z in lower case, the greatest weight of each; null, empty and weightless terms are none."""
    low = F.translate(F.trim("term"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = table.select(low.alias("term"), F.col("weight").cast("double").alias("weight")).filter((F.length("term") > 0) & (F.col("weight") > 0))
    found = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(found) > most or any(len(r.term) > TERM_CHARS for r in found):
        raise ValueError(f"a vocabulary has at most {most} terms of at most {TERM_CHARS} characters")
    return {r.term: r.weight for r in found}


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, float], ...]):
    own = ahocorasick.Automaton()
    for term, weight in terms:
        own.add_word(term, (term, weight))
    own.make_automaton()
    return own


def _plain(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z"


def hits(url: str, terms: tuple[tuple[str, float], ...]) -> dict[str, float]:
    """The distinct terms of a url, and their weights."""
    low, found = url.translate(_UPPER), {}
    if not terms:
        return found
    for end, (term, weight) in _automaton(terms).iter(low):
        start = end - len(term) + 1
        begins = start == 0 or not _plain(low[start - 1]) or start >= 3 and low[start - 3] == "%" and all(c in "0123456789abcdef" for c in low[start - 2 : start])
        if begins and (end + 1 == len(low) or not _plain(low[end + 1])):
            found[term] = weight
    return found


def _judge(rules, terms, limit):
    def run(batches):
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = host_and_path(url)
                rule = rule_for(host, path, rules)
                found = hits(url or "", terms).values()
                strict = sum(w >= limit for w in found)
                own = "block" if found and sum(found) >= limit else "allow"
                rows.append((host, path, rule and rule[0], rule[1] if rule else own, strict, len(found) - strict))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns[:4]], *[pa.array(c, pa.int32()) for c in columns[4:]]], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return run


def filter_urls(pages: DataFrame, rules=RULES, terms: dict[str, float] | None = None, limit: float = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) of every page; n_strict counts distinct terms that reach the limit alone, n_soft the others."""
    bound_batches(pages.sparkSession)
    own = tuple(sorted((default_terms(limit=limit) if terms is None else terms).items()))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(_judge(tuple(rules), own, limit), "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int")
