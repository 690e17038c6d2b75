"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are put into one partition, so that the partitions are
close to independent. Of partitions 1..m with thresholds t that sum to
limit - m + 1, any two fingerprints within `limit` bits agree in some partition
but for t bits; -1 leaves a partition out. Number of partitions and thresholds
are chosen by dynamic programming on candidate counts estimated over all
fingerprints. Each fingerprint is filed under its partition's bits with every
choice of t of them blanked, equal keys are verified bit by bit.

Defined results: a null or empty text has no words and fingerprint 0, which
links like any other; repeated rows are one class; a row without doc_id gets
its class's component; an empty table gives an empty table; columns beside
doc_id and text are not read, those that keep_one carries may have any names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import near_copies
from labelspark.llm.common import batch, bound_batches, keep_rows, longs, materialize, partitions, with_id
from labelspark.llm.components import components

BITS, LIMIT, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one key that are compared in one piece; a larger key is dealt out in pieces of this size, two by two.
PIECE = 4096
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (2, 3, 4)
_STEP = 65_536


def fingerprint(text: bytes) -> int:
    """The SimHash of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), _STEP):
        h = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _STEP], ends[at : at + _STEP], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("fp", pa.int64())])
    for b in batches:
        fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in b.column(1)], np.uint64)
        yield batch(schema, b.column(0), b.column(2), longs(fps.view(np.int64)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint's bits as a long; mark tells apart texts that share a doc_id."""
    bound_batches(documents.sparkSession)
    return with_id(documents, full=True).mapInArrow(_fingerprints, "doc_id long, mark binary, fp long")


def _together(batches):
    """Per task: how often each two bits are both set; row 64 holds the number of fingerprints."""
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        x = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float64)
        total, n = total + x.T @ x, n + len(x)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
    yield batch(schema, np.r_[i, BITS].astype(np.int32), np.r_[j, 0].astype(np.int32), longs(np.r_[total.ravel(), n]))


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Partitions of 64 bits into m parts of near-equal size, the strongest correlations inside them."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
    strength = np.abs(together / max(n, 1) - np.outer(p, p)) / spread
    room = [BITS // m + (k < BITS % m) for k in range(m)]
    parts: list[list[int]] = []
    free = list(range(BITS))
    for size in room:
        part = [max(free, key=lambda b: (strength[b, [x for x in free if x != b]].sum() if len(free) > 1 else 0, -b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][t + 1] over thresholds t from -1 that sum to total; the thresholds."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, cost in enumerate(row, -1):
                if s + t not in step or c + cost < step[s + t][0]:
                    step[s + t] = (c + cost, [*chosen, t])
        best = step
    return best[total]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _filed(classes: DataFrame, masks: list[int]) -> DataFrame:
    """(tag, key, fp) for each mask."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return classes.select(F.posexplode(keys).alias("tag", "key"), "fp")


def choose_masks(classes: DataFrame, limit: int = LIMIT) -> list[int]:
    """The masks under which fingerprints are filed: any two within `limit` bits are equal under one of them."""
    counts = classes.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together, n = np.zeros((BITS, BITS)), 0
    for r in counts:
        if r.i == BITS:
            n = r.n
        else:
            together[r.i, r.j] = r.n
    groups = [(m, part) for m in PARTITIONS for part in group_bits(together, n, m)]
    alike = _filed(classes, [_mask(part) for _, part in groups]).groupBy("tag", "key").agg(F.count("*").alias("c")).filter("c > 1").groupBy("tag").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    pairs = {r.tag: r.pairs for r in alike.collect()}
    best = None
    for m in PARTITIONS:
        own = [(k, part) for k, (q, part) in enumerate(groups) if q == m]
        costs = []
        for k, part in own:
            # blanking t bits files a fingerprint under comb(w, t) keys and about doubles the pairs of each key t times
            random = n * n / 2 ** (len(part) + 1)
            costs.append([0.0] + [comb(len(part), t) * (4 * n + max(pairs.get(k, 0.0), random) * 2**t) for t in range(limit + 1)])
        cost, chosen = allocate(costs, limit - m + 1)
        if best is None or cost < best[0]:
            best = cost, [_mask(set(part) - set(off)) for (_, part), t in zip(own, chosen, strict=True) if t >= 0 for off in combinations(part, t)]
    return best[1]


def _near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= LIMIT


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what links within the limit connect: a breadth-first forest, not all pairs."""
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = _near(rest, u)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                out += [(u, v) for v in found]
                queue += list(found)
    return out


def _verify(batches):
    """Of rows sorted by key and piece, links within each key."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    last, kept = None, []

    def linked(fps):
        found = forest(np.unique(np.concatenate(fps)))
        return links(found)

    def links(pairs):
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return batch(schema, longs(both[:, 0]), longs(both[:, 1]))

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in range(5)]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)]
        starts = np.flatnonzero(new)
        fps = columns[4].view(np.uint64)
        if last is not None and tuple(c[0] for c in columns[:4]) == last:
            first_end = starts[1] if len(starts) > 1 else len(fps)
            kept.append(fps[:first_end])
            starts = starts[1:]
        if len(starts):
            if sum(map(len, kept)) > 1:
                yield linked(kept)
            ends = np.r_[starts[1:], len(fps)]
            sizes = (ends - starts)[:-1]
            two = starts[:-1][sizes == 2]
            two = two[_near(fps[two], fps[two + 1])]
            yield links(np.stack([fps[two], fps[two + 1]], axis=1))
            pairs = [p for i, j in zip(starts[:-1][sizes > 2], ends[:-1][sizes > 2], strict=True) for p in forest(fps[i:j])]
            if pairs:
                yield links(pairs)
            last, kept = tuple(c[starts[-1]] for c in columns[:4]), [fps[starts[-1] :]]
    if sum(map(len, kept)) > 1:
        yield linked(kept)


def linked(classes: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints that connect all fingerprints within the limit of each other."""
    filed = _filed(classes, choose_masks(classes))
    crowded = filed.groupBy("tag", "key").agg(F.count("*").alias("c")).filter(F.col("c") > PIECE).withColumn("pieces", F.ceil(F.col("c") / PIECE).cast("int"))
    dealt = filed.join(crowded.select("tag", "key", "pieces"), ["tag", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("tag", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = dealt.repartition(partitions(classes.sparkSession), "tag", "key", "i", "j").sortWithinPartitions("tag", "key", "i", "j")
    return dealt.mapInArrow(_verify, "u long, v long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, component_id): component_id is the least doc_id that links of at most three differing bits reach."""
    fps = materialize(fingerprints(documents))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked(classes.select("fp")))
    # a component is named after the least document of its fingerprints
    groups = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    member = groups.join(named, "component").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "mark", "fp", "component_id")


def keep_one(documents: DataFrame, least: float | None = None, shingle: int = near_copies.SHINGLE) -> DataFrame:
    """The documents, all their columns: of each group one row, that of its least doc_id (of several texts under it that of the least mark); rows without doc_id stay.

    Groups are those of near_duplicates, or, with `least`, of texts whose sets of
    shingles are at least so similar: links of fingerprints, verified on the sets,
    and those between other texts, for which fingerprints are a screen.
    """
    if least is None:
        found = near_duplicates(documents).withColumnRenamed("component_id", "component")
    else:
        found = near_copies.near_copies(documents, shingle, least, linked)
    found = materialize(found.filter("doc_id is not null").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows")))
    chosen = found.groupBy("component").agg(F.min(F.struct("doc_id", "mark", "rows")).alias("x")).select("x.*")
    return keep_rows(documents, materialize(chosen))
