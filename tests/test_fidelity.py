"""Fidelity of excerpts against a search character by character."""

import html
import random
import re
import unicodedata

from pyspark.sql import functions as F

from labelspark.functions import fidelity as fid


def plain_state(excerpt, text):
    rest, text = fid.comparable(excerpt), fid.comparable(text)
    if not rest or not text:
        return "nao_encontrado"
    if rest in text:
        return "verbatim"
    size, found = len(rest), 0
    while rest:
        n = 0
        while n < len(rest) and rest[: n + 1] in text:
            n += 1
        if n < fid.FRAGMENT:
            break
        found, rest = found + n, rest[n:].lstrip()
    return "recomposto" if found / size >= fid.COVERAGE else "nao_encontrado"


def cases():
    rng = random.Random(5)
    for k in range(300):
        letters = rng.choice(["ab", "abc ", "abcdefgh \n-", "aç α😀é "])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30, 300, 900])))
        cuts = [text[a : a + rng.randrange(10, 90)] for a in (rng.randrange(len(text) + 1) for _ in range(rng.randrange(1, 5)))]
        if rng.random() < 0.3:
            cuts.insert(rng.randrange(len(cuts) + 1), "zq" * rng.randrange(1, 12))
        yield k, text if rng.random() > 0.03 else None, [rng.choice([" ", "", "\n"]).join(cuts), text[3:50], "", None]


def test_states():
    seen = set()
    for _, text, excerpts in cases():
        block = fid.Block(text)
        for e in excerpts:
            assert block.state(e) == plain_state(e, text), (text, e)
            seen.add(plain_state(e, text))
    assert seen == {"verbatim", "recomposto", "nao_encontrado"}


def test_an_excerpt_of_another_text_needs_no_order():
    """Nearly all excerpts of other texts are told by their first characters; an excerpt that begins in the text is still taken in pieces."""
    text = " ".join(map(str, range(4000)))
    block = fid.Block(text)
    assert [block.state(e) for e in ("1 2 3", "none of these words is in there", "12 13 14 - 15", "", None)] == ["verbatim", "nao_encontrado", "nao_encontrado", "nao_encontrado", "nao_encontrado"]
    assert block.order is None
    assert block.state("100 101 102 103 104 105 300 301 302 303 304 305") == "recomposto" and block.order is not None


def test_comparable_is_the_same_for_plain_characters():
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice("aB -\n\t\x1f\x0b\x85\xa0&;#45amp\u2013\u00ad\uff21e\u0301") for _ in range(rng.randrange(30)))
        full = unicodedata.normalize("NFKC", html.unescape(text))
        full = full.translate({**dict.fromkeys(map(ord, fid.INVISIBLE)), **dict.fromkeys(map(ord, fid.DASHES), "-")})
        assert fid.comparable(text) == " ".join(re.sub(r"\s*-\s*", "", full).split()).lower()


def test_longest_prefix():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 80)))
        block, rest = fid.Block(text), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        assert block.longest_prefix(rest) == max(n for n in range(len(rest) + 1) if rest[:n] in block.text)


def test_one_unit_for_all_its_excerpts(spark, monkeypatch):
    """A hot unit in pieces, null keys, units without excerpts, excerpts without unit, columns of any type."""
    monkeypatch.setattr(fid, "PIECE", 50)
    data = list(cases())
    u = spark.createDataFrame([(k, t) for k, t, _ in data] + [(None, "x")], "unit long, texto string")
    some = [(k, e, [k], f"{k}-{i}") for k, _, es in data[10:] for i, e in enumerate(es)] + [(0, data[0][2][0], [i], f"hot{i}") for i in range(400)] + [(None, "x", None, "null"), (999, "x", None, "none")]
    e = spark.createDataFrame(some, "unit long, texto_original string, texto array<long>, id string")
    out = {r.id: r for r in fid.graded(u, e, ["unit"]).collect()}
    texts = {k: t for k, t, _ in data}
    want = {i: (k, said, more, plain_state(said, texts[k])) for k, said, more, i in some if k in texts}
    assert {i: (r.unit, r.texto_original, r.texto, r.fidelidade) for i, r in out.items()} == want
    assert fid.graded(u, e.filter(F.lit(False)), ["unit"]).count() == 0
