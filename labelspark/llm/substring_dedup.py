"""Substring dedup: words under a window of 50 that also starts in a smaller document go.

Anchors of 20 words are hashed only at positions whose remainder by 31 lies in
a difference cover. Any two places that share 50 words have, within the first
31 of them, one offset at which both stand on a cover position, so they share
an anchor there. Anchors that two documents hold are then extended: the windows
around them, and no others, are hashed whole and compared.

Defined results: a null text has no words; a row without doc_id keeps all its
words and holds none for others; rows that repeat a doc_id are one document
with several texts, judged each on its own words; an empty table gives an empty
table; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, materialize, with_id
from labelspark.llm.first_seen import by_range, held_before, ranged

WINDOW = 50
#: A perfect difference set: each remainder by 31 is the difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_MARK = 0x7FFFFFFF


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 09-0D."""
    return text.split()


def _bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words when one space joins them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def cover_positions(n: int) -> np.ndarray:
    """Where anchors start in a document of n words that has a window."""
    if n < WINDOW:
        return np.empty(0, np.int64)
    p = np.arange(n - ANCHOR + 1)
    return p[np.isin(p % PERIOD, COVER)]


def _anchors(borders):
    schema = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("part", pa.int32())])

    def run(batches):
        for b in batches:
            hashes, docs, places = [], [], []
            for doc, text, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(text.as_buffer().to_pybytes())
                if len(words) < WINDOW:
                    continue
                joined = b" ".join(words)
                starts, ends = _bounds(words)
                at = cover_positions(len(words))
                hashes.append(np.frombuffer(b"".join([xxhash.xxh3_64_digest(joined[i:j]) for i, j in zip(starts[at].tolist(), ends[at + ANCHOR - 1].tolist(), strict=True)]), ">i8").astype(np.int64))
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at << 31 | mark)
            if hashes:
                yield ranged(schema, [np.concatenate(x) for x in (hashes, docs, places)], borders)

    return run


def _shared(batches):
    """Of a stream sorted by anchor and document, the rows of anchors that two documents hold.

    The first and the last anchor of a partition may go on elsewhere; their
    rows all come out, which costs a comparison and loses nothing. Only rows of
    one anchor and one document are ever held back.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64())])
    anchor = first_doc = None  # of the run that is open
    shared, held = True, []  # held: rows of the open run, all of first_doc, while no second document is known
    for b in batches:
        if not b.num_rows:
            continue
        a, doc, pos = (b.column(k).to_numpy() for k in range(3))
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        ends = np.r_[starts[1:], len(a)]
        several = doc[starts] != doc[ends - 1]
        goes_on = anchor is not None and a[0] == anchor
        if anchor is None:
            several[0] = True
        elif goes_on:
            several[0] = shared or doc[ends[0] - 1] != first_doc
            if several[0]:
                yield from held
        if not (goes_on and len(starts) == 1 and not several[0]):
            held = []
        out = np.repeat(several, ends - starts)
        if out.any():
            yield batch(schema, longs(doc[out]), longs(pos[out]))
        if not several[-1]:
            held.append(batch(schema, longs(doc[starts[-1] :]), longs(pos[starts[-1] :])))
        if not (goes_on and len(starts) == 1):
            first_doc = doc[starts[-1]]
        anchor, shared = a[-1], bool(several[-1])
    yield from held


def _around(batches):
    """Documents without a shared anchor are finished here; the others go on with their words and the starts of windows to compare."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("mark", pa.int64()), ("words", pa.binary()), ("starts", pa.binary())])
    zip_ = zstandard.ZstdCompressor(level=1)
    for b in batches:
        rows = []
        for doc, mark, text, anchors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            words = split_words(text.as_buffer().to_pybytes())
            joined = b" ".join(words)
            if anchors.as_py() is None:
                rows.append((doc, len(words), hashlib.sha256(joined).hexdigest(), None, None, None))
            else:
                at = np.asarray(anchors.values.to_numpy(), np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                some = np.cumsum(edge)[: len(words) - WINDOW + 1] > 0
                rows.append((doc, len(words), None, mark, zip_.compress(joined), np.packbits(some).tobytes()))
        yield batch(schema, *map(list, zip(*rows, strict=True))) if rows else batch(schema, *[[]] * 6)


def _windows(borders):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("part", pa.int32())])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, mark, zipped, starts_ in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                joined = unzip.decompress(zipped)
                starts, ends = _bounds(joined.split(b" "))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(starts_, np.uint8))[: len(starts) - WINDOW + 1])
                for part in np.array_split(at, len(at) // 100_000 + 1):
                    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(starts[part].tolist(), ends[part + WINDOW - 1].tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
                    yield ranged(schema, [h[:, 0], h[:, 1], np.full(len(part), doc, np.int64), part << 31 | mark], borders)

    return run


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, zipped, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = unzip.decompress(zipped).split(b" ")
            gone = covered(len(words), np.asarray(starts.values.to_numpy(), np.int64)) if starts.is_valid else np.zeros(len(words), bool)
            rows.append((doc, len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone, strict=True) if not x])))
        yield batch(schema, *map(list, zip(*rows, strict=True))) if rows else batch(schema, *[[]] * 4)


def _lists(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id", F.col("pos").bitwiseAND(F.lit(_MARK)).alias("mark")).agg(F.collect_set(F.shiftright("pos", 31)).alias(name))


def _judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents finished at once, and (doc_id, words, starts) of those that share an anchor."""
    bound_batches(documents.sparkSession)
    docs = with_id(documents)
    dealt = by_range(docs.filter("doc_id is not null"), _anchors, ("a", "doc_id", "pos"))
    anchors = _lists(dealt.mapInArrow(_shared, "doc_id long, pos long"), "anchors")
    joined = docs.join(anchors.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "anchors")
    around = materialize(joined.mapInArrow(_around, "doc_id long, n_words long, sha string, mark long, words binary, starts binary"))
    open_ = around.filter("words is not null").select("doc_id", "mark", "words", "starts")
    starts = _lists(held_before(open_, _windows), "gone")
    return around.filter("words is null"), open_.join(starts.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "words", "gone")


def substring_report(documents: DataFrame) -> DataFrame:
    """Per document: its words, how many go, and the digest of the rest joined by one space."""
    done, judged = _judged(documents)
    cut = judged.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
    return done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")).unionByName(
        cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    )


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of the documents that lose words, the words that stay joined by one space."""
    cut = _judged(documents)[1].mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
    return cut.filter("n_removed > 0").select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("text"))
