"""Approximate nearest neighbours by a few stable projections under a kd-tree.

Largest inner product becomes least distance once each vector gets one more
component that lifts all to the largest norm. Gaussian (2-stable) projections
to M dimensions then keep distances in the sense that the ratio of squared
projected to squared true distance is chi-square with M degrees of freedom. A
kd-tree yields projected neighbours, leaves nearest first; each is verified on
the original vectors unless its projected distance is one that a vector nearer
than the present k-th neighbour would exceed with a probability below 1 - P
only, and the search stops at the first leaf as far away.

Queries near each other search as a block: they share the leaves, and one
product of matrices verifies what the test leaves to any of them. A vector is
read once a block, not once a query, and no query verifies less than alone.

The index is a coarse kd-tree over a bounded sample, whose leaves are shards,
and a kd-tree of its own in each shard; every vector is indexed, and a shard of
too many vectors is dealt out in pieces. A query searches its own shard, then,
in rounds of one, two, four and so on, the nearest of those that the stopping
test does not rule out; each round hands the k-th score on to the next. Shards
grow with the vectors up to what a worker holds, so that until then the number
of shards, and of rows sent for a query, stays the same.

Defined results: vectors that are null, zero or hold a null or non-finite
component take no part, nor do rows without vec_id; shorter vectors are filled
up with zeros; a query never finds rows of its own vec_id; identical vectors
share one place in the index and come out by vec_id, repeated rows repeatedly;
query rows that repeat both vec_id and vector are one query, those that share
only the vec_id are queries of their own under one query_id; an empty table
gives an empty table; labels and other columns are not read.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, materialize, partitions
from labelspark.llm.vector_dedup import matrix, valid_vector

K, M, P, SEED = 20, 15, 0.92, 20240229
#: Vectors a shard is meant to hold at least, and bytes of vectors at most beyond that; rows of the sample that places the shards' borders, and so a bound on their number.
SHARD, HELD, SAMPLE = 16_384, 32 << 20, 32_768
#: Queries that visit one copy of a shard of SHARD vectors, more of a larger one; a shard that more visit is copied. So no more vectors are copied than queries sent.
VISITS = 16_384
#: Vectors of a leaf, leaves read at once, queries that search together, scores computed again at once.
LEAF, WIDE, BLOCK, AGAIN = 64, 32, 128, 16_384


def chi2_cdf(x: float, m: int) -> float:
    """Distribution function of chi-square with m degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * exp(-half + a * log(half) - lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, m))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component that brings each vector to the given norm."""
    return np.c_[x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))]


def split(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree, as row numbers: halves along the widest dimension until a leaf holds at most size rows."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        part = points[rows]
        d = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = rows[np.argpartition(part[:, d], len(rows) // 2)]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return leaves


def borders(sample: np.ndarray, shards: int) -> list[tuple[int, float, int, int]]:
    """A coarse kd-tree as nodes (dimension, border, left, right); a child below 0 is leaf -1 - child."""
    nodes: list[list] = []
    leaves = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal leaves
        if parts == 1 or len(points) < 2:
            leaves += 1
            return -leaves
        d = int((points.max(axis=0) - points.min(axis=0)).argmax())
        left = parts // 2
        cut = float(np.quantile(points[:, d], left / parts))
        nodes.append([d, cut, 0, 0])
        at = len(nodes) - 1
        below = points[:, d] <= cut
        nodes[at][2] = grow(points[below], left)
        nodes[at][3] = grow(points[~below], parts - left)
        return at

    grow(sample, shards)
    return [tuple(x) for x in nodes]


def place(points: np.ndarray, nodes) -> np.ndarray:
    """The shard of each point."""
    at = np.full(len(points), 0 if nodes else -1)
    while (at >= 0).any():
        for k in np.unique(at[at >= 0]):
            d, cut, left, right = nodes[k]
            rows = at == k
            at[rows] = np.where(points[rows, d] <= cut, left, right)
    return -1 - at


class Shard:
    """Vectors, their projections, and the kd-tree's leaves and boxes. It counts the pairs it verifies."""

    def __init__(self, x: np.ndarray, ids: list, projected: np.ndarray):
        leaves = split(projected, LEAF)
        order = np.concatenate(leaves)
        self.x, self.ids = x[order], [ids[k] for k in order]
        self.first = np.array([i[0] for i in self.ids])
        # times (-2 p, |p|^2 - reach, 1): by how much a squared distance in the projection exceeds the reach
        self.p = np.c_[projected[order], np.ones(len(order)), (projected[order] ** 2).sum(axis=1)]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.low = np.array([projected[rows].min(axis=0) for rows in leaves])
        self.high = np.array([projected[rows].max(axis=0) for rows in leaves])
        self.verified = 0

    def search(self, q: np.ndarray, p: np.ndarray, far: np.ndarray, own: int, norm: float, k: int, stop: float, known: float) -> tuple[list, list]:
        """Scores and ids of the k best of this shard; p: the query's projection, far: its squared distances to the boxes, known: the k-th score from elsewhere, or -inf."""
        return self.search_block(q[None], p[None], far[None], [own], norm, k, stop, np.array([known]))[0]

    def search_block(self, q: np.ndarray, p: np.ndarray, far: np.ndarray, own: list, norm: float, k: int, stop: float, known: np.ndarray) -> list[tuple[list, list]]:
        """As search, for each of several queries."""
        own_square, p_square = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", p, p)
        # the margin is for rounding: distances come as differences, and neighbours may be equal but for the last bit
        square, kth = (own_square + norm * norm) * (1 + 1e-12), known.astype(float)
        # by so much a product of matrices may differ from the scores as they are returned
        slack = 4e-16 * q.shape[1] * norm * np.sqrt(own_square)
        who, rows, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = far.min(axis=0)
        boxes, at, step = np.argsort(least, kind="stable"), 0, 4
        while at < len(boxes):
            reach = np.where(kth == -np.inf, np.inf, stop * np.maximum(square - 2 * kth, 0))
            if least[boxes[at]] > reach.max():
                break
            some = boxes[at : at + step]
            at, step = at + step, min(2 * step, WIDE)
            near = far[:, some] <= reach[:, None]
            some, asked = some[near.any(axis=0)], np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            new = np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in some])
            # the stopping test on each projected neighbour
            fine = np.c_[-2 * p[asked], (p_square - reach)[asked], np.ones(len(asked))] @ self.p[new].T <= 0
            new, asked = new[fine.any(axis=0)], asked[fine.any(axis=1)]
            x = self.x[new]
            score = q[asked] @ x.T
            self.verified += score.size
            a, b = np.divmod(np.flatnonzero(score >= (kth - slack)[asked, None]), len(new))
            # each pair's own sum: it does not depend on the pairs around it
            parts = [slice(i, i + AGAIN) for i in range(0, len(a), AGAIN)]
            again = np.concatenate([np.einsum("ij,ij->i", q[asked[a[i]]], x[b[i]]) for i in parts] or [best[:0]])
            hit = again >= kth[asked[a]]
            who, rows, best = np.r_[who, asked[a[hit]]], np.r_[rows, new[b[hit]]], np.r_[best, again[hit]]
            order = np.lexsort((self.first[rows], -best, who))
            place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            # one place more than k: the query's own vector may be among them
            order, place = order[place <= k], place[place <= k]
            who, rows, best = who[order], rows[order], best[order]
            last = place == k
            kth[who[last]] = np.maximum(kth[who[last]], best[last])
        out, ends = [], np.searchsorted(who, np.arange(len(q) + 1)).tolist()
        for n, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
            pairs = sorted((-s, v) for s, r in zip(best[i:j].tolist(), rows[i:j].tolist(), strict=True) for v in self.ids[r] if v != own[n])[:k]
            out.append(([-s for s, _ in pairs], [v for _, v in pairs]))
        return out


def _distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def shard_size(n: int, dim: int, parts: int) -> int:
    """Vectors a shard is meant to hold: as many shards as 16, or partitions, so long as what one holds has its bounds."""
    return max(SHARD, min(n // max(16, parts), HELD // (8 * dim)))


def _placed(dim: int, norm: float, nodes, query: bool):
    directions = projection(dim)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"), dim)
                p = (np.c_[x, np.zeros(len(x))] if query else lifted(x, norm)) @ directions
                shape = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(place(p, nodes).astype(np.int32)), *b.columns, pa.ListArray.from_arrays(shape, pa.array(p.ravel()))], names=["shard", *b.schema.names, "p"])

    return run


_PLACED = "shard int, ids array<long>, embedding array<double>, p array<double>"
_FOUND = "query long, query_id long, vec_id long, score double"
_SENT = ("shard", "copy", "kind", "ids", "embedding", "p", "known", "query")


def _searched(dim: int, norm: float, k: int, stop: float):
    """Of rows sorted by shard, copy, kind (0: vectors, 1: queries) and id: the best of each query in that shard."""

    def run(batches):
        schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        now, held, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at, copy, kind, query = (b.column(c).to_numpy() for c in (0, 1, 2, 7))
            x, p = matrix(b.column(4), dim), matrix(b.column(5), M)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (copy[1:] != copy[:-1])])
            for i, j in zip(cuts, np.r_[cuts[1:], len(at)], strict=True):
                if (at[i], copy[i]) != now:
                    now, held, shard = (at[i], copy[i]), [], None
                cut = i + int((kind[i:j] == 0).sum())
                if cut > i:
                    held.append((x[i:cut], b.column(3).slice(i, cut - i).to_pylist(), p[i:cut]))
                if cut < j and held:
                    if shard is None:
                        shard = Shard(np.concatenate([h[0] for h in held]), [ids for h in held for ids in h[1]], np.concatenate([h[2] for h in held]))
                        held = [held[0]]
                    ids, known = [i[0] for i in b.column(3).slice(cut, j - cut).to_pylist()], b.column(6).to_numpy(zero_copy_only=False)
                    out = ([], [], [], [])
                    for block in split(p[cut:j], BLOCK):
                        own, block = [ids[n] for n in block], cut + block
                        far = _distances(p[block], shard.low, shard.high)
                        for n, i, (scores, found) in zip(block, own, shard.search_block(x[block], p[block], far, own, norm, k, stop, known[block]), strict=True):
                            for column, values in zip(out, ([query[n]] * len(found), [i] * len(found), found, scores), strict=True):
                                column.extend(values)
                    yield batch(schema, *map(longs, out[:3]), out[3])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _onward(low: np.ndarray, high: np.ndarray, shards: list[int], dim: int, norm: float, stop: float, first: int, last: int):
    """Each query with the shards that are, but for its own, its first to last nearest and that the stopping test does not rule out."""
    numbers = np.array(shards, np.int32)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, p, known, home = matrix(b.column(2), dim), matrix(b.column(3), M), b.column(4).to_numpy(), b.column(0).to_numpy()
            far = _distances(p, low, high)
            far[home[:, None] == numbers] = np.inf
            near = np.argsort(far, axis=1, kind="stable")[:, first:last]
            reach = stop * np.maximum((x * x).sum(axis=1) + norm * norm - 2 * known, 0)
            q, c = np.nonzero((d := np.take_along_axis(far, near, axis=1)) <= np.where(np.isfinite(d), reach[:, None], -1))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[near[q, c]]), *[column.take(pa.array(q)) for column in b.columns[1:]]], names=b.schema.names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, p: float = P) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) up to k rows of vectors with the largest inner products found."""
    spark = vectors.sparkSession
    bound_batches(spark)

    def rows(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(valid_vector() & F.col("vec_id").isNotNull())

    # of identical vectors the k + 1 least ids decide every result; the window's limit applies before the exchange too
    w = Window.partitionBy("embedding").orderBy("vec_id")
    places = rows(vectors).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    places = materialize(places.select("ids", "embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    size = places.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(square).alias("square")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, norm, stop = size.dim, float(np.sqrt(size.square)), chi2_quantile(p, M)
    full = shard_size(size.n, dim, partitions(spark))
    sample = places.orderBy(F.xxhash64("ids")).limit(min(SAMPLE, 16 * (size.n // SHARD + 1))) if size.n > SHARD else places.limit(0)
    points = [r.p for r in sample.mapInArrow(_placed(dim, norm, [], False), _PLACED).select("p").collect()]
    nodes = borders(np.array(points), min(size.n // full + 1, len(points) // 8 + 1)) if points else []
    index = materialize(places.mapInArrow(_placed(dim, norm, nodes, False), _PLACED))
    boxes = index.select("shard", F.posexplode("p").alias("d", "x")).groupBy("shard", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()
    shards = sorted({r.shard for r in boxes})
    low, high = np.zeros((len(shards), M)), np.zeros((len(shards), M))
    row_of = {s: i for i, s in enumerate(shards)}
    # what no worker holds at once is dealt out; every query of the shard visits all its pieces
    pieces = {r.shard: -(-r.n // (2 * full)) for r in boxes if r.n > 2 * full}
    for r in boxes:
        low[row_of[r.shard], r.d], high[row_of[r.shard], r.d] = r.low, r.high
    asked = rows(queries).dropDuplicates(["vec_id", "embedding"]).select(F.array("vec_id").alias("ids"), "embedding").mapInArrow(_placed(dim, norm, nodes, True), _PLACED)
    asked = materialize(asked.withColumn("known", F.lit(float("-inf"))).withColumn("query", F.monotonically_increasing_id()))

    def by_shard(values: dict[int, int], otherwise: int):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("shard")), F.lit(otherwise)) if values else F.lit(otherwise)

    def search(visits: DataFrame) -> DataFrame:
        """visits: rows of asked, each with the shard it visits."""
        counts = {r.shard: -(-r["count"] // (VISITS * full // SHARD)) for r in visits.groupBy("shard").count().collect()}
        copies, split_in = by_shard(counts, 0), by_shard(pieces, 1)
        # of a shard in pieces, copy c of piece i is copy c * pieces + i
        held = index.filter(copies > 0).withColumn("c", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))))
        held = held.withColumn("copy", ((F.col("c") - 1) * split_in + F.pmod(F.xxhash64("ids"), split_in.cast("long"))).cast("int"))
        held = held.select("shard", "copy", F.lit(0).alias("kind"), "ids", "embedding", "p", F.lit(0.0).alias("known"), F.lit(0).cast("long").alias("query"))
        own = F.pmod(F.xxhash64("ids"), F.greatest(copies, F.lit(1)).cast("long")).cast("int")
        sent = visits.withColumn("copy", F.explode(F.transform(F.sequence(F.lit(0), split_in - 1), lambda i: (own * split_in + i).cast("int"))) if pieces else own)
        sent = sent.select("shard", "copy", F.lit(1).alias("kind"), "ids", "embedding", "p", "known", "query")
        both = held.unionByName(sent).repartition(partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", "kind", F.col("ids")[0]).select(*_SENT)
        return materialize(both.mapInArrow(_searched(dim, norm, k, stop), _FOUND))

    found, first, width = search(asked), 0, 1
    while first < len(shards) - 1:
        kth = _best(found, k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        onward = asked.drop("known").join(kth, "query", "left").select("shard", "ids", "embedding", "p", F.coalesce("kth", F.lit(float("-inf"))).alias("known"), "query")
        visits = materialize(onward.mapInArrow(_onward(low, high, shards, dim, norm, stop, first, first + width), "shard int, ids array<long>, embedding array<double>, p array<double>, known double, query long"))
        found, first, width = found.unionByName(search(visits)), first + width, 2 * width
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
