"""Near copies for SimHash near-dedup: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: classes whose fingerprints are equal or linked within three
bits, which partitions of bits find as in op7_simhash, are verified on their whole
sets, in one turn with the first of the pairs below. It cannot find all. Two sets that similar share one of the first
n - ceil(0.8 n) + 1 elements of each under any common order, so for the rest every text is filed under those of its shingles;
shingles that a bounded sample of texts finds common come last in that order,
which decides the cost and not the result. Pairs under one key whose sizes and
five-word SimHashes allow it, and whose sketches of the smallest hashes agree
well enough, are verified on their whole sets. Only the texts of such pairs are
read again.

Fingerprints alone do not find these: at 0.8 a bit differs with a chance of
0.152, so links would need 27 of 64 bits, for which the pigeonhole principle
files every text with a large part of all others. There they screen.

Texts with equal sets are one class, and only classes are filed. A group of near
copies is not compared pair by pair. Members of a key are first held against the
one of them that shares most keys, which in a group of copies is the text that
the others were made of, then against a random one. Only what the links found so
far leave in different components goes on: under small keys pair by pair; the
members of large keys are gathered by lead and compared there by the same
screens, groups too large for a task in pieces, two by two. Where very many pairs
pass, the members that are in such pairs are compared by differences; texts that
share no more than a passage with the lead differ from it in all else and are
not among them. Let A and B be the
symmetric differences of two members' sets x and y to the set of the group's lead. Then
x and y differ as A and B do, so a link needs |A| + |B| - (|x| + |y|) / 9 over 2
elements in both. Where one of them has no link to the lead that is more than
none, and rare elements first, the leading parts of A and B must meet: copies
with changes of their own meet in nothing and are never paired.

Every pair of 0.8 or more ends in one component but for those that the screens
lose: as many bits may differ, and as few sketched hashes agree, as in all but
one pair of ten million at the similarity asked for, 27 at 0.8 bits at 0.8, where a bit differs with a chance of
0.152, and 77 of 128 hashes.

Defined results: a null or empty text has no words, and all such are copies of
each other; a text of fewer words is one shingle; repeated rows are copies; rows
without doc_id stay, and name no component; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, discard, longs, materialize, partitions, with_id
from labelspark.llm.components import components

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: The share of links that each screen may lose, the least set to which that by SimHash applies, and hashes of a sketch.
LOST, SCREENED, SKETCH = 1e-7, 32, 128
#: Members of a key up to which those in different components are compared pair by pair, members of a group's piece, two of which one task compares, and pairs for each of them that may go on.
SMALL, GROUP, DENSE = 32, 1024, 4
#: Texts of the sample, and shingles it may call common.
SAMPLE, COMMON = 8192, 65_536
_STEP = 65_536


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k, digest = min(size, len(words)), xxhash.xxh64_digest
    w = np.frombuffer(b"".join([digest(x, SEED) for x in words]), ">u8").astype(np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def simhash(own: np.ndarray) -> int:
    """The SimHash of a set, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), _STEP):
        ones += np.unpackbits(own[at : at + _STEP].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own)).view(np.int64)[0])


@cache
def screen(least: float) -> int:
    """Bits in which the SimHashes of two sets of this similarity differ at most, but for LOST of all pairs. Equal sizes are the worst case: the angle between them is the arc cosine of 2 s / (1 + s)."""
    p, some, bits = math.acos(2 * least / (1 + least)) / math.pi, 0.0, -1
    while some < 1 - LOST and bits < 64:
        bits += 1
        some += math.comb(64, bits) * p**bits * (1 - p) ** (64 - bits)
    return bits


@cache
def agreement(least: float) -> int:
    """How many of the SKETCH smallest hashes of two sets' union lie in both at least, but for LOST of all pairs of this similarity."""
    some = 0.0
    for k in range(SKETCH + 1):
        some += math.comb(SKETCH, k) * least**k * (1 - least) ** (SKETCH - k)
        if some > LOST:
            return k
    return SKETCH


def sketch(own: np.ndarray) -> bytes:
    """The smallest hashes of a sorted set, their upper halves."""
    return (own[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes()


def agree(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sketches allow the similarity."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if len(x) < SKETCH and len(y) < SKETCH:  # whole sets; halves of hashes may meet by chance, so none is lost
        shared = len(np.intersect1d(x, y))
        return shared >= least * (len(x) + len(y) - shared) - 1e-9
    if len(x) < SKETCH or len(y) < SKETCH:
        return True
    union = np.sort(np.concatenate((x, y)))
    double = np.flatnonzero(union[1:] == union[:-1])
    # the SKETCH smallest of the union end where so many different ones have been seen
    seen = np.arange(1, len(double) + 1)
    return int(np.count_nonzero(double + 2 - seen <= SKETCH)) >= agreement(least)


def need(n: int, least: float) -> int:
    return math.ceil(least * n - 1e-9)


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The elements under which a set is filed."""
    often = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, often))[: len(own) - need(len(own), least) + 1 if len(own) else 0]]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), longs(np.concatenate(values).view(np.int64) if values else []))


def _sets(size: int):
    """(node, text) to (node, own)."""

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("own", pa.list_(pa.int64()))])
        for b in batches:
            yield batch(schema, b.column(0), _lists([shingles(t.as_buffer().to_pybytes(), size) for t in b.column(1)]))

    return run


def _sketches(size: int, least: float, common: np.ndarray, counts: np.ndarray):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("sim", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
        for b in batches:
            own = [shingles(t.as_buffer().to_pybytes(), size) for t in b.column(1)]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in own]
            yield batch(schema, b.column(0), b.column(2), digests, longs([len(x) for x in own]), longs([simhash(x) for x in own]), [sketch(x) for x in own], _lists([prefix(x, common, counts, least) for x in own]))

    return run


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, sorted, and in how many texts."""
    total = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(max(total, 1))) < SAMPLE)
    sets = some.select(F.lit(0).cast("long").alias("node"), "text").mapInArrow(_sets(size), "node long, own array<long>")
    often = sets.select(F.explode("own").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _own_sets(nodes: DataFrame, reps: DataFrame, rows: DataFrame, size: int, known: list[DataFrame]) -> DataFrame:
    """(node, own) of the nodes. known: the sets of earlier turns, to which those of other nodes are added."""
    wanted = nodes
    for df in known:
        wanted = wanted.join(df.select("node"), "node", "left_anti")
    # written, so that its size is known: few places are broadcast and spare the texts an exchange, many are not
    places = materialize(wanted.join(reps, "node").select("node", F.col("doc_id").alias("_d"), F.col("mark").alias("_m")))
    texts = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")))
    known.append(materialize(texts.select("node", "text").mapInArrow(_sets(size), "node long, own array<long>").dropDuplicates(["node"])))
    discard(places)
    own = known[0]
    for df in known[1:]:
        own = own.unionByName(df)
    return own


def _verified(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) those as similar as asked."""
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= least * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def _agreeing(least: float, batches):
    """Of pairs (u, v, a, b) those whose sketches a and b agree."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for b in batches:
        keep = np.array([agree(x, y, least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], bool)
        yield batch(schema, *(longs(b.column(k).to_numpy()[keep]) for k in range(2)))


def _sketched(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose sketches (row, sketch) agree."""
    of = lambda name, out: sketches.select(F.col("row").alias(name), F.col("sketch").alias(out))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(partial(_agreeing, least), "u long, v long")


def _paired(least: float, dense: int, batches):
    """Of rows (lead, i, j, node, n, sim, c, own, sketch) sorted by lead, i and j, each a group's pieces i and j, candidates (lead, u, v) in different components c and, unless i = j, in different pieces; for pieces with too many of them each member that is in one, as u and v."""
    schema = pa.schema([("lead", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
    at, held = None, []

    def pairs():
        node, n, sim, c, piece = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:5])
        order = np.argsort(n, kind="stable")
        node, n, sim, c, piece, own = node[order], n[order], sim[order].view(np.uint64), c[order], piece[order], [held[k][5] for k in order]
        out, seen, crowded = [], np.zeros(len(node), bool), False
        for k in range(len(node) - 1):
            # partners are larger, up to where the sizes allow no link
            near = np.arange(k + 1, np.searchsorted(n, n[k] / least + 1e-9, side="right"))
            near = near[c[near] != c[k]]
            if at[1] != at[2]:
                near = near[piece[near] != piece[k]]
            if n[k] >= SCREENED:
                near = near[np.bitwise_count(sim[near] ^ sim[k]) <= screen(least)]
            for j in near:
                # once the members count and not the pairs, a pair of two that are known says nothing
                if not (crowded and seen[j] and seen[k]) and agree(own[k], own[j], least):
                    seen[j] = seen[k] = True
                    if not crowded:
                        out.append((max(node[k], node[j]), min(node[k], node[j])))
            crowded = crowded or len(out) > dense * len(node)
        both = np.stack([node[seen]] * 2, axis=1) if crowded else np.array(out, np.int64).reshape(-1, 2)
        return batch(schema, longs(np.full(len(both), at[0])), longs(both[:, 0]), longs(both[:, 1]))

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
            if row[:3] != at and held:
                yield pairs()
                held = []
            at = row[:3]
            held.append(row[3:])
    if held:
        yield pairs()


def _in_groups(grouped: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Candidates (lead, u, v) among the members of groups (lead, node, n, sim, c), with (lead, node, node) for members that are too much alike. A group of more than GROUP is dealt out in pieces of about that size, two by two."""
    parts = partitions(grouped.sparkSession)
    pieces = grouped.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("pieces"))
    dealt = grouped.join(pieces, "lead").withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces").cast("long")).cast("int"))
    dealt = dealt.join(sketches.select(F.col("row").alias("node"), "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = dealt.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "sim", "c", "own", "sketch")
    return rows.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(partial(_paired, least, DENSE), "lead long, u long, v long")


def _by_difference(grouped: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Candidates (u, v) among the members of grouped (lead, node, n, sim, c), each lead a group, that differences to the lead allow; a link without a member that has none to its lead is left out.

    With r = (1 - least) / (1 + least), 1/9 for 0.8, x and y are linked if they
    differ in at most r (|x| + |y|) elements. The bounds on places follow from
    the overlap this asks of A and B and from the sizes that links allow.
    """
    r = (1 - least) / (1 + least)
    sets = own.select("node", "own")
    # the leads' sets are written, so that few of them are broadcast and the members' sets not dealt out again
    of_lead = materialize(grouped.select(F.col("lead").alias("node")).distinct().join(sets, "node").select(F.col("node").alias("lead"), F.col("own").alias("of_lead")))
    both = grouped.join(sets, "node").join(of_lead, "lead")
    apart = F.concat(F.array_except("own", "of_lead"), F.array_except("of_lead", "own"))
    members = materialize(both.select("lead", "node", "n", "sim", "c", F.size("of_lead").alias("nl"), apart.alias("apart")).withColumn("na", F.size("apart")))
    elements = members.select("lead", "node", F.explode("apart").alias("e"))
    # elements that one member alone has come first in its order and meet nothing: their number is enough
    often = materialize(elements.groupBy("lead", "e").agg(F.count("*").alias("f")).filter("f > 1"))
    own_rows = Window.partitionBy("lead", "node")
    shared = elements.join(often, ["lead", "e"]).select("lead", "node", "e", F.row_number().over(own_rows.orderBy("f", "e")).alias("nth"), F.count("*").over(own_rows).alias("all"))
    placed = shared.join(members.drop("apart").withColumn("far", F.col("na") > r * (F.col("n") + F.col("nl")) + 1e-9), ["lead", "node"])
    placed = placed.withColumn("at", F.col("na") - F.col("all") + F.col("nth") - 1).drop("nth", "all")
    # the most that r (|x| + |y|) can be, and so the last place a far member's partner may share with it
    most = r * (1 + 1 / least) * F.col("n")
    held = F.when(F.col("far"), F.col("at") <= most / 2 + 1e-6).otherwise(F.col("at") <= (F.col("na") + r * (F.col("n") - F.col("nl"))) / 2 + 1e-6)
    placed = materialize(placed.withColumns({"held": held, "asks": F.col("far") & (F.col("at") <= most + 1e-6)}).filter("held or asks").drop("nl"))
    asks = placed.filter("asks").select("lead", "e", *[F.col(x).alias(f"o{x}") for x in ("node", "n", "sim", "c", "na", "at")])
    s = r * (F.col("n") + F.col("on"))
    order = ~F.col("far") | (F.struct("na", "node") < F.struct("ona", "onode"))
    meet = (F.col("at") <= (F.col("na") - F.col("ona") + s) / 2 + 1e-6) & (F.col("oat") <= (F.col("ona") - F.col("na") + s) / 2 + 1e-6)
    near = placed.filter("held").join(asks, ["lead", "e"]).filter((F.col("c") != F.col("oc")) & order & meet & _possible(least))
    return near.select(F.greatest("node", "onode").alias("u"), F.least("node", "onode").alias("v"))


def _possible(least: float):
    """Whether sizes and SimHashes of two members, with those of the other under names that begin with o, allow the similarity."""
    sizes = F.least("n", "on") >= least * F.greatest("n", "on") - 1e-9
    return sizes & ((F.least("n", "on") < SCREENED) | (F.bit_count(F.col("sim").bitwiseXOR(F.col("osim"))) <= screen(least)))


def _against(members: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Candidates (u, v): members of a key with the others (key, o) of it that are in another component and allow the similarity."""
    others = others.select("key", *[F.col(f"o.{x}").alias(f"o{x}") for x in ("node", "n", "sim", "c")])
    near = members.join(others, "key").filter((F.col("c") != F.col("oc")) & _possible(least))
    return near.select(F.greatest("node", "onode").alias("u"), F.least("node", "onode").alias("v"))


def _by_fingerprint(reps: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates (u, v) by SimHash: classes of one fingerprint with the first of them, and the first ones of fingerprints that linked connects."""
    lead = materialize(reps.groupBy("sim").agg(F.min("node").alias("lead"), F.count("*").alias("several")))
    same = reps.join(lead.filter("several > 1"), "sim").filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    of = lambda name: lead.select(F.col("sim").alias(name), F.col("lead").alias(f"l{name}"))
    near = linked(lead.select(F.col("sim").alias("fp"))).join(of("u"), "u").join(of("v"), "v").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v"))
    return same.unionByName(near)


def near_copies(documents: DataFrame, size: int = SHINGLE, least: float = LEAST, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, mark, component): rows that links of `least` or more reach share a component.

    linked: fingerprints (fp) to links (u, v) between near ones, which are
    tried in the first turn.
    """
    bound_batches(documents.sparkSession)
    rows = with_id(documents, full=True)
    common, counts = _common(rows, size)
    out = "doc_id long, mark binary, digest binary, n long, sim long, sketch binary, keys array<long>"
    sketches = materialize(rows.mapInArrow(_sketches(size, least, common, counts), out).withColumn("row", F.monotonically_increasing_id()))
    classes = sketches.groupBy("digest").agg(F.min("row").alias("node"))
    stats = materialize(sketches.drop("keys", "sketch").join(classes, "digest").drop("digest"))
    reps = stats.filter("row = node").select("node", "doc_id", "mark", "n", "sim")

    # one row of each class is filed, and a key is counted before its rows move
    copies = stats.filter("row <> node").select("row")
    filed = sketches.join(copies, "row", "left_anti").select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    several = filed.groupBy("key").agg(F.count("*").alias("_c")).filter("_c > 1").select("key")
    keyed = materialize(filed.join(several, "key"))
    # whether a member is in many keys that others share decides who leads
    many = keyed.groupBy("node").agg(F.count("*").alias("many"))
    member = materialize(keyed.join(many.join(reps.select("node", "n", "sim"), "node"), "node"))
    discard(keyed)

    links = tested = found = now = None
    known: list[DataFrame] = []
    for turn in range(3):
        discard(now)
        if found is None:
            now = member.withColumn("c", F.col("node"))
        else:
            now = member.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        apart = now.groupBy("key").agg(F.min("c").alias("_a"), F.max("c").alias("_b"), F.count("*").alias("size")).filter("_a <> _b").select("key", "size")
        now = materialize(now.join(apart, "key"))
        rank = F.xxhash64("node") if turn == 1 else F.struct(-F.col("many"), F.xxhash64("node"))
        if turn < 2:
            near = _against(now, now.groupBy("key").agg(F.min(F.struct(rank.alias("h"), "node", "n", "sim", "c")).alias("o")), least)
            if turn == 0 and linked:
                near = _by_fingerprint(reps, linked).unionByName(near)
        else:
            # what is not in the key's largest component against all members
            few = now.filter(F.col("size") <= SMALL)
            sizes = few.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("most"))
            near = _against(few, few.join(sizes, "key").filter("c <> most.c").select("key", F.struct("node", "n", "sim", "c").alias("o")), least)
            crowd = now.filter(F.col("size") > SMALL)
            lead = crowd.groupBy("key").agg(F.min(F.struct(rank.alias("h"), "node")).alias("o")).select("key", F.col("o.node").alias("lead"))
            grouped = materialize(crowd.join(lead, "key").select("lead", "node", "n", "sim", "c").distinct())
            found_here = materialize(_in_groups(grouped, sketches, least))
            near = near.unionByName(found_here.filter("u <> v").select("u", "v"))
            alike = grouped.join(found_here.filter("u = v").select("lead", F.col("u").alias("node")).distinct(), ["lead", "node"])
            if not alike.isEmpty():
                own = _own_sets(alike.select(F.explode(F.array("lead", "node")).alias("node")).distinct(), reps, rows, size, known)
                near = near.unionByName(_by_difference(alike, own, least))
        pairs = near.distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")
        pairs = materialize(_sketched(pairs, sketches, least))
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        own = _own_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), reps, rows, size, known)
        more = materialize(_verified(pairs, own, least))
        links = more if links is None else links.unionByName(more)
        found = materialize(components(links))
    discard(sketches, now, member, *known)
    if found is None:
        return stats.select("doc_id", "mark", F.col("node").alias("component"))
    return stats.join(found, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("component"))
