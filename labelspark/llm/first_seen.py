"""First occurrences of hashes over a range-partitioned, secondarily sorted stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, longs, materialize, partitions

KEY = ("h1", "h2", "doc_id", "pos")
_EMITTED = "kind int, part int, h1 long, h2 long, doc_id long, pos long"
DROP, PENDING, HEAD, TAIL = 0, 1, 2, 3
#: Rows of the source from which borders are read, how many more for each partition, and about how many rows made of each. They decide how even partitions are, and no result.
SAMPLE, MORE, PER_ROW = 2048, 8, 16


def places(keys: list[np.ndarray], borders: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted borders, tuples over the same columns, are at most as large as each key."""
    low, high = (np.searchsorted(borders[0], keys[0], side) for side in ("left", "right"))
    if len(keys) == 1:
        return high
    for value in np.unique(keys[0][low < high]):
        rows = np.flatnonzero(keys[0] == value)
        i, j = low[rows[0]], high[rows[0]]
        low[rows] = i + places([k[rows] for k in keys[1:]], [b[i:j] for b in borders[1:]])
    return low


def ranged(schema: pa.Schema, columns: list[np.ndarray], borders: list[np.ndarray] | None) -> pa.RecordBatch:
    """A batch of the columns, all of them keys and the last but one the document, and of their partition, which comes last in the schema. Without borders only a sample of each document's rows, evenly spaced."""
    if borders is None:
        doc = columns[-2]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(doc)])
        nth = np.arange(len(doc)) - np.repeat(starts, sizes)
        columns = [c[nth % np.repeat(-(-sizes // PER_ROW), sizes) == 0] for c in columns]
        return batch(schema, *map(longs, columns), np.zeros(len(columns[0]), np.int32))
    return batch(schema, *map(longs, columns), places(columns, borders).astype(np.int32))


def by_range(source: DataFrame, emit: Callable, keys: tuple[str, ...]) -> DataFrame:
    """The rows (keys, all long and not null) that emit makes of the source (doc_id, mark, ...), in partitions by range and sorted inside by all keys.

    emit takes borders, or None, and gives a function for mapInArrow whose rows
    end in their partition. Borders come from a bounded sample of the source, so
    the rows are made once; Spark's own range exchange would make them twice.
    """
    parts = partitions(source.sparkSession)
    schema = ", ".join(f"{k} long" for k in keys) + ", part int"
    size = SAMPLE + MORE * parts
    some = source.filter(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(max(source.count(), 1))) < size)
    seen = some.mapInArrow(emit(None), schema).select(*keys).toArrow()
    columns = [seen.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])[[k * seen.num_rows // parts for k in range(1, parts)]] if seen.num_rows else np.empty(0, np.int64)
    made = source.mapInArrow(emit([c[order] for c in columns]), schema)
    return made.repartitionById(parts, "part").select(*keys).sortWithinPartitions(*keys)


def _stream(batches):
    """Rows of a sorted partition whose hash an earlier document of the same partition holds.

    The partition's first hash may have begun in an earlier partition: rows of
    its first document here are pending, and HEAD and TAIL rows say with which
    hash and first document the partition starts and ends.
    """
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])
    part = TaskContext.get().partitionId()
    head = tail = None  # (h1, h2, first document)
    in_first = True
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, pos = (b.column(k).to_numpy() for k in range(4))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = tail is not None and (h1[0], h2[0]) == tail[:2]
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = doc[starts].copy()
        if goes_on:
            first[0] = tail[2]
        if head is None:
            head = (h1[0], h2[0], doc[0])
        in_first_here = (run == 0) & (in_first and (goes_on or tail is None))
        in_first = in_first and (goes_on or tail is None) and len(starts) == 1
        own = doc == first[run]
        tail = (h1[-1], h2[-1], first[-1])
        for kind, rows in ((DROP, ~own), (PENDING, own & in_first_here)):
            if rows.any():
                n = int(rows.sum())
                yield batch(schema, np.full(n, kind, np.int32), np.full(n, part, np.int32), longs(h1[rows]), longs(h2[rows]), longs(doc[rows]), longs(pos[rows]))
    if head is not None:
        for kind, (a, b_, d) in ((HEAD, head), (TAIL, tail)):
            yield batch(schema, np.array([kind], np.int32), np.array([part], np.int32), longs([a]), longs([b_]), longs([d]), longs([0]))


def held_before(source: DataFrame, emit: Callable) -> DataFrame:
    """(doc_id, pos) of the rows (h1, h2, doc_id, pos) made of the source whose hash a smaller doc_id holds too.

    One range exchange on the hash, then document, then position: a hash that
    holds a third of all rows spreads over as many partitions as it needs. The
    driver sees two rows a partition, from which it decides what was pending,
    and the sample that by_range takes.
    """
    dealt = by_range(source, emit, KEY)
    emitted = materialize(dealt.mapInArrow(_stream, _EMITTED))
    edges: dict[int, dict] = {}
    for r in emitted.filter(F.col("kind") >= HEAD).collect():
        edges.setdefault(r.part, {})[r.kind] = (r.h1, r.h2, r.doc_id)
    drop, last = [], None
    for part in sorted(edges):
        head, tail = edges[part][HEAD], edges[part][TAIL]
        if last is not None and last[:2] == head[:2]:
            if last[2] < head[2]:
                drop.append(part)
            if tail[:2] == head[:2]:
                tail = (*tail[:2], min(last[2], tail[2]))
        last = tail
    gone = F.col("kind") == DROP
    if drop:
        gone = gone | ((F.col("kind") == PENDING) & F.col("part").isin(drop))
    return emitted.filter(gone).select("doc_id", "pos")
