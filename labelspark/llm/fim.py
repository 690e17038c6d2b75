r"""Fill-in-middle by big-integer bit-parallelism.

A text is cut into lines, and two of the places between lines, drawn from a
digest of the document's id, part it into prefix, middle and suffix, which are
written in another order behind three sentinels:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text alone

All work on a text is done on whole numbers with one bit for each of its bytes:
`bytes.translate` and a conversion by two make the mask of a class of bytes, one
shift of the newlines' mask marks where lines start, `bit_count` gives their
number, a sentinel stands where the shifted masks of its bytes meet, and the
k-th line's start is found by halving the mask again and again, each time going
on with the half that holds it. Newlines and sentinels are single bytes in
UTF-8 that no other code point contains, so bytes serve for code points; those
are counted by the mask of bytes that begin one.

Defined results: a null text is empty; an empty text and one that holds a
sentinel stay plain, with no cut; a null doc_id is drawn for like an empty one;
repeated rows come out once each, alike; ties of the two draws leave an empty
middle; an empty table gives an empty table; other columns are not read. A text
is handled by one task, in memory of a few times its own size.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, spread

#: Sentinels of prefix, suffix and middle, the seed of the draws, and how many of 100 texts are cut and of those put suffix first.
SENTINELS, SEED, RATE, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), "7", 100, 50
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: For each byte the table that marks it alone, and one that marks all bytes but those that go on with a code point.
_ONLY = [bytes(49 if k == b else 48 for k in range(256)) for b in range(256)]
_BEGINS = bytes(48 if k & 0xC0 == 0x80 else 49 for k in range(256))


def mask(data: bytes, table: bytes) -> int:
    """The number whose bit k says whether the table marks byte k."""
    return int(data.translate(table)[::-1], 2) if data else 0


def line_starts(data: bytes) -> int:
    """Bits at the first bytes of lines; a newline ends its line."""
    return (mask(data, _ONLY[10]) << 1 | 1) & ((1 << len(data)) - 1)


def nth_bit(bits: int, nth: int) -> int:
    """The place of the nth set bit, from 0."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if nth < below:
            bits, width = low, half
        else:
            bits, width, at, nth = bits >> half, width - half, at + half, nth - below
    return at


def holds(data: bytes, words: tuple[bytes, ...]) -> bool:
    """Whether one of the words stands in data."""
    seen: dict[int, int] = {}
    for word in words:
        where = -1
        for k, byte in enumerate(word):
            if byte not in seen:
                seen[byte] = mask(data, _ONLY[byte])
            where &= seen[byte] >> k
            if not where:
                break
        if where:
            return True
    return False


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in range(0, 32, 8))


def transform(data: bytes, doc_id: int | None, sentinels: tuple[bytes, bytes, bytes], seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(lines, form, code points of the prefix, of the middle, output)."""
    starts = line_starts(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or holds(data, sentinels):
        return n, PLAIN, None, None, data
    a, b = (len(data) if k == n else nth_bit(starts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    begins = mask(data, _BEGINS)
    before, middle = (begins & ((1 << a) - 1)).bit_count(), (begins >> a & ((1 << b - a) - 1)).bit_count()
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return n, SPM, before, middle, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, PSM, before, middle, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The sentinels' bytes, if what they part can be told from them: each begins with an ASCII character that none of them holds further on, and none begins with another."""
    firsts = {x[:1] for x in sentinels}
    if len(set(sentinels)) < 3 or any(x != y and x.startswith(y) for x in sentinels for y in sentinels) or any(not c.isascii() or c in x[1:] for c in firsts for x in sentinels):
        raise ValueError(f"sentinels are three different strings that cannot overlap: {sentinels}")
    return tuple(x.encode() for x in sentinels)


def _transformed(sentinels: tuple[bytes, bytes, bytes], seed: str, rate: int, suffix_first: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [transform(t.as_buffer().to_pybytes(), i, sentinels, seed, rate, suffix_first) for i, t in zip(ids, b.column(1), strict=True)]
            n, form, before, middle, texts = zip(*out, strict=True) if out else ((),) * 5
            yield batch(schema, pa.array(ids, pa.int64()), longs(n), form, before, middle, pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def fill_in_middle(documents: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; sentinels are those of prefix, suffix and middle. No exchange but where the table comes in fewer pieces than there are cores."""
    bound_batches(documents.sparkSession)
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")))
    return rows.mapInArrow(_transformed(_checked(sentinels), seed, rate, suffix_first), _SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text out of which the output was made."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), 4)
    return F.when(form == PSM, F.concat(parts[1], parts[3], parts[2])).when(form == SPM, F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fim_report(documents: DataFrame, **settings) -> DataFrame:
    """What was cut, with digests of the output and of the text rebuilt from it."""
    sentinels = settings.get("sentinels", SENTINELS)
    out = fill_in_middle(documents, **settings)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), sentinels)).alias("restored_sha256"))
