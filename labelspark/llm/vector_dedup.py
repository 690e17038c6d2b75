"""Embedding near-dedup: an exact range join in a metric space partitioned by pivots.

Angles between vectors are a metric. Each vector is at home in the cell of its
nearest pivot. A vector also visits every other cell in which something within
the radius can live: its angle to that pivot may exceed neither the cell's
widest home angle plus the radius nor its own home angle plus twice the radius
(triangle inequality), and it may lie no further than the radius's chord beyond
the plane half-way between both pivots. For a few reference pivots each cell
also keeps its least and greatest home angle; a visitor must come within the
radius of all these spans. Cells are then joined independently, home vectors in
bounded blocks against the cell's stream of members.

Pivots are a bounded sample's vectors that lie far apart. Into how many cells
they part the vectors follows from the bounds of all vectors, taken for several
numbers of cells in one reading, and from what these rule out for vectors of the
sample that are no pivots: where they rule out little, few large cells in large
blocks copy each vector less often than many small ones. Cells that would copy
vectors more often than blocks alone are never chosen, so copies grow at most
with the root of the vectors as long as blocks may grow, and in proportion to
them beyond (with 64 dimensions from 10^8 vectors). No result depends on it.

Identical vectors are one class with a count; all links between different
vectors are compared in double precision.

Defined results: vectors that are null, zero or hold a null or non-finite
component link with nothing and form a component each; shorter vectors are
filled up with zeros; repeated rows are vectors of their own and link with each
other; a row without vec_id links with nothing, has no component and stays; an
empty table gives an empty table; labels and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, materialize, partitions
from labelspark.llm.components import components

THRESHOLD = 0.9
#: Vectors that the smallest cells are meant to hold, the most pivots, the vectors they are chosen from, and pivots whose spans each cell keeps.
CELL, MAX_PIVOTS, SAMPLE, REFERENCES = 4096, 2048, 16_384, 16
#: Bytes that the sample may take on the driver, and its vectors on which numbers of cells are tried.
SAMPLE_BYTES, TRIED = 128 << 20, 2048
#: A block of home vectors grows with the root of their number, so that the copies of a vector do too: the least block, its growth, and the bytes that one may take.
BLOCK, GROWTH, HELD = 8192, 36, 256 << 20
#: Members compared with a block at once, and how many of its dot products a copy costs that is written, sent, sorted and read (both grow with the dimensions).
STEP, COPY = 512, 16_384
#: A single-precision dot product of unit vectors is at most so far off; nearer pairs are compared in double precision.
MARGIN = 1e-4


def valid_vector(column: str = "embedding"):
    """Not null, not zero, no null or non-finite component."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up to dim with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(flat) == dim * len(column):
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors, each the one that lies furthest from those before."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def numbers_of_cells(most: int) -> list[int]:
    """The numbers of cells that are tried, from the most to one."""
    return [most] if most == 1 else [most, *numbers_of_cells(max(1, most // 4))]


def _spans(pivots: np.ndarray):
    """For each number k of cells, cell and reference pivot the least and greatest angle of the cell's home vectors; reference -1 is the cell's own pivot."""

    def run(batches):
        schema = pa.schema([("k", pa.int32()), ("cell", pa.int32()), ("ref", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])
        for b in batches:
            if b.num_rows:
                a = _angles(unit(matrix(b.column(0), pivots.shape[1])), pivots)
                for k in numbers_of_cells(len(pivots)):
                    cells, *rest = spans(a[:, :k])
                    yield batch(schema, np.full(len(cells), k, np.int32), cells, *rest)

    return run


def spans(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of vectors' angles to all pivots (cell, ref, low, high, n), as bounds() takes them."""
    home = a.argmin(axis=1)
    a = np.c_[a[np.arange(len(a)), home], a[:, :REFERENCES]]
    cells, at = np.unique(home, return_inverse=True)
    low, high = np.full((len(cells), a.shape[1]), np.inf), np.full((len(cells), a.shape[1]), -np.inf)
    np.minimum.at(low, at, a)
    np.maximum.at(high, at, a)
    refs = np.arange(a.shape[1]) - 1
    return np.repeat(cells, len(refs)).astype(np.int32), np.tile(refs, len(cells)).astype(np.int32), low.ravel(), high.ravel(), np.repeat(np.bincount(at), len(refs)).astype(np.int64)


def bounds(rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (cell, ref, low, high, n): each cell's widest angle to its pivot, its spans by reference pivot, and how many are at home."""
    widest, counts = np.zeros(k), np.zeros(k, np.int64)
    low, high = np.full((k, min(k, REFERENCES)), np.inf), np.full((k, min(k, REFERENCES)), -np.inf)
    for cell, ref, least, most, n in rows:
        if ref < 0:
            widest[cell], counts[cell] = most, n
        else:
            low[cell, ref], high[cell, ref] = least, most
    return widest, low, high, counts


def visits(x: np.ndarray, pivots: np.ndarray, widest: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and for each cell whether the vector belongs to it, at home or as a visitor."""
    slack, dots = 1e-7, x @ pivots.T
    a = np.arccos(np.clip(dots, -1, 1))
    home = a.argmin(axis=1)
    own = np.arange(len(x))
    there = (a <= widest + radius + slack) & (a <= a[own, home][:, None] + 2 * radius + slack)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))[home]
    beyond = (dots[own, home][:, None] - dots) / apart  # from the plane half-way between both pivots
    there &= beyond <= 2 * np.sin(radius / 2) + slack
    for ref in range(low.shape[1]):
        there &= (a[:, ref, None] >= low[:, ref] - radius - slack) & (a[:, ref, None] <= high[:, ref] + radius + slack)
    there[own, home] = True
    return home, there


def block_size(n: int, dim: int) -> int:
    return int(min(max(BLOCK, GROWTH * n**0.5), max(HELD // (12 * dim), 1)))


def choose_cells(tried: np.ndarray, pivots: np.ndarray, measured: dict[int, tuple], n: int, radius: float) -> int:
    """Of the numbers of cells with the bounds measured for them on all n vectors the one whose copies and comparisons cost least for the vectors tried.

    One cell in blocks copies each vector once a block; a number of cells that copies more often is left out.
    """
    block, best = block_size(n, pivots.shape[1]), None
    for k in sorted(measured):
        widest, low, high, counts = measured[k]
        there = visits(tried, pivots[:k], widest, low, high, radius)[1]
        blocks = np.ceil(counts / block)
        copies, cost = (float((there * w).sum(axis=1).mean()) for w in (blocks, counts + COPY * blocks))
        if best is None or (copies <= blocks_alone and cost < best[0]):
            best = cost, k
        if k == 1:
            blocks_alone = copies
    return best[1]


def _members(pivots: np.ndarray, widest: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: np.ndarray, radius: float, kind: str):
    """Each vector once at home, in one block of its cell, and once for each block of each cell that it must be compared in; vectors travel as bytes."""

    def run(batches):
        schema = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("guest", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = matrix(b.column(2), pivots.shape[1])
            home, there = visits(unit(raw), pivots, widest, low, high, radius)
            packed = np.array([x.tobytes() for x in raw.astype(kind)], object)
            row, cell = np.nonzero(there)
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            own = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[home]
            row, cell, block, guest = np.r_[np.arange(len(raw)), row], np.r_[home, cell], np.r_[own, block], np.r_[np.zeros(len(raw), int), np.ones(len(row), int)]
            for part in np.array_split(np.arange(len(row)), len(row) // 8192 + 1):
                yield batch(schema, cell[part].astype(np.int32), block[part].astype(np.int32), guest[part].astype(np.int32), longs(ids[row[part]]), longs(n[row[part]]), packed[row[part]].tolist())

    return run


def linked_pairs(home: np.ndarray, home32: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Where the cosine of unit vectors reaches the threshold: screened in single precision, decided in double precision where that is too coarse."""
    sims = home32 @ v.astype(np.float32).T
    hit = sims >= threshold
    r, c = np.nonzero(np.abs(sims - threshold) < MARGIN)
    for k in range(0, len(r), 65_536):
        i, j = r[k : k + 65_536], c[k : k + 65_536]
        hit[i, j] = np.einsum("ij,ij->i", home[i], v[j]) >= threshold
    return hit


def _join(kind: str, dim: int, threshold: float):
    """Of rows sorted by cell, block and guest: for each home vector its links (kind 0: id, number), and links that connect (kind 1: id, id)."""

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])
        now, ids, x, links, label = None, [], [], None, None

        def done():
            if now is not None and links is not None:
                yield batch(schema, np.zeros(len(links), np.int32), longs(home_ids), longs(links))

        for b in batches:
            if not b.num_rows:
                continue
            cell, block, guest, own, n = (b.column(k).to_numpy() for k in range(5))
            v = unit(np.frombuffer(b"".join(b.column(5).to_pylist()), kind).reshape(-1, dim).astype(np.float64))
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])])
            for i, j in zip(cuts, np.r_[cuts[1:], len(cell)], strict=True):
                if (cell[i], block[i]) != now:
                    yield from done()
                    now, ids, x, links, label = (cell[i], block[i]), [], [], None, None
                at_home = i + int((guest[i:j] == 0).sum())
                if at_home > i:
                    ids.append(own[i:at_home])
                    x.append(v[i:at_home])
                if at_home < j and ids:
                    if links is None:
                        home_ids, home = np.concatenate(ids), np.concatenate(x)
                        home32 = home.astype(np.float32)
                        links, label = np.zeros(len(home_ids), np.int64), home_ids.copy()
                    for k in range(at_home, j, STEP):
                        g = slice(k, min(j, k + STEP))
                        r, c = np.nonzero(linked_pairs(home, home32, v[g], threshold))
                        other = home_ids[r] != own[g][c]
                        r, c = r[other], c[other]
                        if not len(r):
                            continue
                        links += np.bincount(r, n[g][c], len(links)).astype(np.int64)
                        before, theirs = label.copy(), own[g].copy()
                        while True:  # the least label spreads over what these links connect
                            low, lab = theirs.copy(), label.copy()
                            np.minimum.at(low, c, label[r])
                            np.minimum.at(lab, r, low[c])
                            if (low == theirs).all() and (lab == label).all():
                                break
                            theirs, label = low, lab
                        moved, touched = label != before, theirs != own[g]
                        u, w = np.r_[before[moved], own[g][touched]], np.r_[label[moved], theirs[touched]]
                        if len(u):
                            pairs = np.unique(np.stack([u, w], axis=1), axis=0)
                            yield batch(schema, np.ones(len(pairs), np.int32), longs(pairs[:, 0]), longs(pairs[:, 1]))
        yield from done()

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; two link if their cosine is at least the threshold."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"  # exact either way
    fine = valid_vector() & F.col("vec_id").isNotNull()
    classes = materialize(rows.filter(fine).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    rest = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size.n:
        return rest
    taken = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size.dim)))
    sample = unit(matrix(classes.orderBy(F.xxhash64("least"), "least").limit(taken).select("embedding").toArrow().combine_chunks().column(0).combine_chunks(), size.dim))
    # vectors that are tried are no pivots, unless there are few
    tried = sample[-TRIED:]
    pivots = far_apart(sample[:-TRIED] if len(sample) >= 2 * TRIED else sample, int(min(max(1, size.n // cell), MAX_PIVOTS)))
    radius = float(np.arccos(threshold))
    found = classes.select("embedding").mapInArrow(_spans(pivots), "k int, cell int, ref int, low double, high double, n long").groupBy("k", "cell", "ref").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
    measured = {k: bounds([r[1:] for r in found if r[0] == k], k) for k in numbers_of_cells(len(pivots))}
    pivots = pivots[: choose_cells(tried, pivots, measured, size.n, radius)]
    widest, low, high, counts = measured[len(pivots)]
    blocks = np.maximum(-(-counts // block_size(size.n, size.dim)), 1)
    members = classes.select("id", "n", "embedding").mapInArrow(_members(pivots, widest, low, high, blocks, radius, kind), "cell int, block int, guest int, id long, n long, v binary")
    dealt = members.repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "guest")
    found = materialize(dealt.mapInArrow(_join(kind, size.dim, threshold), "kind int, u long, v long"))
    links = found.filter("kind = 0").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("links"))
    parts = components(found.filter("kind = 1").select("u", "v")).withColumnRenamed("node", "id")
    judged = classes.join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = judged.join(named, "component").select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.filter(fine).join(judged, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(rest)
