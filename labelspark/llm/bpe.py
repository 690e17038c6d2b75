"""Byte-level BPE by the tiktoken library and a local rank file.

Long texts are cut before a plain space or newline that follows something other
than white space. No match of the splitting pattern crosses such a place and
what follows is matched without looking back, so the ids are those of the whole
text. Decoding concatenates the ids' raw bytes.

Defined results: a null text is empty and has no ids; strings of special tokens
are ordinary text; repeated rows each come out; an empty table gives an empty
table; columns beside doc_id, text and those named in carry are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, spread

#: Characters of a text that the library gets at once, where a safe place for a cut can be found.
PIECE = 16_384
#: Texts whose ids, and what they decode to, a worker holds at once.
ROWS = 256
#: A run of white space of this length is encoded past the pattern, which would look back over it.
RUN = 4096


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding, and the bytes of each id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places, each piece of about size characters or as long as it takes to the next place."""
    out, start, at = [], 0, size
    while at < len(text):
        if text[at] in " \n" and not text[at - 1].isspace():
            out.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    out.append(text[start:])
    return out


def _white(c: str) -> bool:
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def _encode_piece(own: tiktoken.Encoding, piece: str) -> list[int]:
    """Runs of white space too long for the pattern's look-back are one match each, but for a last character that the next match may take."""
    ids, done, k = [], 0, 0
    if len(piece) >= RUN:
        while k < len(piece):
            if not _white(piece[k]):
                k += 1
                continue
            end = k
            while end < len(piece) and _white(piece[end]):
                end += 1
            if end - k >= RUN:
                last = end if end == len(piece) else end - 1
                ids += own.encode_ordinary(piece[done:k]) + own._encode_single_piece(piece[k:last])
                done = last
            k = end
    return ids + own.encode_ordinary(piece[done:])


def encode(own: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return _encode_piece(own, text)
    return [i for piece in pieces(text) for i in _encode_piece(own, piece)]


def decode(table: list[bytes], ids) -> bytes:
    return b"".join([table[i] for i in ids])


def _encode_all(path: str, pattern: str):
    def run(batches):
        own, _ = encoding(path, pattern)
        for b in batches:
            k = b.schema.get_field_index("text")
            ids = [np.array(encode(own, t or ""), np.int32) for t in b.column(k).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != k], lists], names=[*[n for i, n in enumerate(b.schema.names) if i != k], "ids"])

    return run


def _texts_of(documents: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    bound_batches(documents.sparkSession)
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in carry]))


def encode_texts(documents: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids): the ids of each whole text; carry names whole-number columns that come along."""
    return _texts_of(documents, carry).mapInArrow(_encode_all(path, pattern), f"doc_id long, {_longs(carry)}ids array<int>")


def _longs(carry: tuple[str, ...]) -> str:
    return "".join(f"`{c}` long, " for c in carry)


def _decoded(carry: tuple[str, ...]) -> str:
    return f"doc_id long, {_longs(carry)}n_tokens long, ids_sha256 string, decoded binary"


def _decode_all(path: str, pattern: str, carry: tuple[str, ...]):
    def run(batches):
        _, table = encoding(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in carry], ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.binary())])
        for b in batches:
            ids = [np.asarray(x.values.to_numpy(), np.uint32) for x in b.column(1)]
            yield batch(schema, b.column(0), *b.columns[2:], longs([len(x) for x in ids]), [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [decode(table, x.tolist()) for x in ids])

    return run


def decode_ids(encoded: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded): raw bytes, whether or not they are valid text."""
    return encoded.select("doc_id", "ids", *carry).mapInArrow(_decode_all(path, pattern, carry), _decoded(carry))


def _round_trip(path: str, pattern: str, carry: tuple[str, ...]):
    """Encoding, then decoding. Two steps of Spark would keep two workers a task, each with its own encoding, and both stay for all later jobs."""

    def few(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield b.slice(k, ROWS)

    def run(batches):
        encoded = _encode_all(path, pattern)(few(batches))
        yield from _decode_all(path, pattern, carry)(b.select(["doc_id", "ids", *carry]) for b in encoded)
        pa.default_memory_pool().release_unused()  # the worker stays for later jobs

    return run


def bpe_report(documents: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document, with the columns that carry names: the number of ids, their digest, and the digest of the bytes that they decode to."""
    out = _texts_of(documents, carry).mapInArrow(_round_trip(path, pattern, carry), _decoded(carry))
    return out.select("doc_id", *carry, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
