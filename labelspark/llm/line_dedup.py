"""Line dedup: every repeated line stays only in the smallest document that holds it.

Hashes of line keys are range-partitioned with documents and positions as the
secondary sort; first occurrences are streamed, and what comes back for a
document is a compressed bitmap of the lines it keeps, not its text.

Defined results: a null or empty text is one empty line; a row without doc_id
keeps all its lines and holds none for others; rows that repeat a doc_id are
one document with several texts, each with its own bitmap; an empty table gives
an empty table; columns beside doc_id and text are carried or ignored, never
read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, with_id
from labelspark.llm.first_seen import held_before, ranged

#: Keys of fewer code points are never dropped.
MIN_KEY = 10
_HASHED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("part", pa.int32())])


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, ASCII letters lowered."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key) - sum((c & 0xC0) == 0x80 for c in key) >= least


def _hash_lines(least: int, borders):
    def run(batches):
        for b in batches:
            digests, docs, places = [], [], []
            for doc, text, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                n = len(digests)
                for k, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    if _long_enough(key := line_key(line), least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(k << 31 | mark)
                docs += [doc] * (len(digests) - n)
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield ranged(_HASHED, [h[:, 0], h[:, 1], np.array(docs, np.int64), np.array(places, np.int64)], borders)

    return run


def pack(drops: list[int]) -> bytes:
    """The keep bitmap of a document: bit k is line k, up to the last line dropped; later lines stay."""
    keep = np.ones(-(-(max(drops) + 1) // 8) * 8, bool)
    keep[drops] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n].astype(bool)
        keep[: len(bits)] = bits
    return keep


def _pack_all(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("keep", pa.binary())])
    for b in batches:
        yield batch(schema, b.column(0), b.column(1), [pack(x) for x in b.column(2).to_pylist()])


def line_bitmaps(documents: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, mark, keep) of the documents that lose lines; mark tells apart texts that share a doc_id."""
    bound_batches(documents.sparkSession)
    gone = held_before(with_id(documents).filter("doc_id is not null"), partial(_hash_lines, min_key))
    mark, line = F.col("pos").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftright("pos", 31)
    lists = gone.groupBy("doc_id", mark.alias("mark")).agg(F.collect_set(line).alias("lines"))
    return lists.mapInArrow(_pack_all, "doc_id long, mark long, keep binary")


def _joined(documents: DataFrame, bitmaps: DataFrame, *more) -> DataFrame:
    return with_id(documents, *more).join(bitmaps.hint("shuffle_hash"), ["doc_id", "mark"], "left")


def _kept(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not keep:
        return text, len(lines), 0
    flags = unpack(keep, len(lines))
    return b"\n".join(x for x, k in zip(lines, flags, strict=True) if k), len(lines), int((~flags).sum())


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        out = [_kept(t.as_buffer().to_pybytes(), k) for t, k in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
        yield batch(schema, b.column(0), longs([x[1] for x in out]), longs([x[2] for x in out]), [hashlib.sha256(x[0]).hexdigest() for x in out])


def line_report(documents: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Per document: its lines, how many it loses, and the digest of what stays."""
    joined = _joined(documents, line_bitmaps(documents, min_key)).select("doc_id", "text", "keep")
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _texts(batches):
    for b in batches:
        k = b.schema.get_field_index("text")
        out = [_kept(t.as_buffer().to_pybytes(), x)[0] for t, x in zip(b.column("text"), b.column("keep").to_pylist(), strict=True)]
        columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == k else b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "keep"]
        yield pa.RecordBatch.from_arrays(columns, names=[x for x in b.schema.names if x != "keep"])


def dedup_lines(documents: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The documents, all their columns under their own names and types, with the texts that stay (a null text: empty)."""
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    joined = _joined(documents, line_bitmaps(documents, min_key), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).drop("mark")
    kept = joined.mapInArrow(_texts, ", ".join(f"{f.name} {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in joined.schema if f.name != "keep"))
    own = {"text": "text", "doc_id": "doc_id"} | {c: f"c{k}" for k, c in enumerate(rest)}
    return kept.select(*[F.col(own[f.name]).cast(f.dataType).alias(f.name) for f in documents.schema])
