"""Vector operators against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from labelspark.llm import ann, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cell int"


def vectors(seed=4, n=700, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    rows = [(int(k), x.tolist()) for k, x in enumerate(base)]
    for k in range(0, 60, 3):  # groups of near copies, some in chains
        x = base[k].astype(float)
        for j in range(12):
            x = x + rng.standard_normal(dim) * np.linalg.norm(x) * 0.09
            rows.append((1000 + k * 20 + j, x.astype(np.float32).tolist()))
    rows += [(5000 + k, base[5].tolist()) for k in range(40)] + [(5100, (base[5] * 3).tolist())]
    rows += [(6000, None), (6001, [0.0] * dim), (6002, [float("nan")] * dim), (6003, [float("inf")] + [1.0] * (dim - 1)), (6004, [None] + [1.0] * (dim - 1)), (6005, []), (None, base[5].tolist())]
    rows += [(7000, base[9][:5].tolist()), rows[3]]
    return [(i, v, 1, 2) for i, v in rows]


def usable(rows):
    dim = max(len(v) for _, v, *_ in rows if v)
    out = []
    for k, (i, v, *_) in enumerate(rows):
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        out.append((k, i, np.array(v + [0.0] * (dim - len(v)))))
    return out


@pytest.mark.parametrize("cell", [64, 100_000])
def test_near_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vector_dedup, "BLOCK", 50)
    rows = vectors()
    good = usable(rows)
    x = np.array([v for *_, v in good])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    while True:
        new = np.minimum(label, np.where(link, label, len(u)).min(axis=1))
        if (new == label).all():
            break
        label = new
    ids = np.array([i for _, i, _ in good])
    least = {g: ids[label == g].min() for g in set(label)}
    want = {k: (i, int(link[r].sum()), int(least[label[r]]), bool(i == least[label[r]])) for r, (k, i, _) in enumerate(good)}
    want = sorted([want.get(k, (i, 0, i, True)) for k, (i, *_) in enumerate(rows)], key=str)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, vector_dedup.near_vectors(df, cell=cell).collect()), key=str) == want
    assert max(w[1] for w in want) >= 40


def test_visits_lose_no_pair():
    rng = np.random.default_rng(0)
    x = vector_dedup.unit(np.concatenate([rng.standard_normal((400, 6)), np.repeat(rng.standard_normal((20, 6)), 10, axis=0) + rng.standard_normal((200, 6)) * 0.2]))
    pivots = x[::40]
    radius = float(np.arccos(0.9))
    angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
    home = angles.argmin(axis=1)
    widest, low, high, counts = vector_dedup.bounds(zip(*(c.tolist() for c in vector_dedup.spans(vector_dedup._angles(x, pivots))), strict=True), len(pivots))
    assert np.allclose(widest, [angles[home == c, c].max(initial=0) for c in range(len(pivots))]) and (counts == np.bincount(home, minlength=len(pivots))).all()
    found, there = vector_dedup.visits(x, pivots, widest, low, high, radius)
    assert (found == home).all() and there.sum() < 0.6 * there.size
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert there[b, home[a]].all()


def chosen(x, n, dim=64):
    """The pivots chosen for n vectors like those of x, and how many copies a vector then gets."""
    radius = float(np.arccos(0.9))
    pivots = vector_dedup.far_apart(x[:-1000], min(n // 4096, 2048))
    measured = {}
    for k in vector_dedup.numbers_of_cells(len(pivots)):
        rows = [c.tolist() for c in vector_dedup.spans(np.concatenate([vector_dedup._angles(part, pivots[:k]) for part in np.array_split(x, 10)]))]
        widest, low, high, counts = vector_dedup.bounds(zip(*rows, strict=True), k)
        measured[k] = widest, low, high, counts * (n / len(x))
    k = vector_dedup.choose_cells(x[-1000:], pivots, measured, n, radius)
    there = vector_dedup.visits(x[-1000:], pivots[:k], *measured[k][:3], radius)[1]
    return k, there.mean(), float((there * np.ceil(measured[k][3] / vector_dedup.block_size(n, dim))).sum(axis=1).mean())


def test_cells_follow_what_the_bounds_rule_out():
    """Tight clusters get many cells and few visits."""
    rng = np.random.default_rng(1)
    tight = np.repeat(rng.standard_normal((40, 64)), 100, axis=0) + rng.standard_normal((4000, 64)) * 0.1
    rng.shuffle(tight)
    k, visited, _ = chosen(vector_dedup.unit(tight), 1_000_000)
    assert k >= 15 and visited < 0.25


@pytest.mark.parametrize("n", [10**6, 10**7, 10**8, 10**9])
def test_copies_never_exceed_those_of_blocks(n):
    """Vectors without clusters: copies stay at those of blocks alone, which grow with the root of the vectors while blocks may grow."""
    loose = vector_dedup.unit(np.random.default_rng(1).standard_normal((20_000, 64)))
    _, _, copies = chosen(loose, n)
    block = vector_dedup.block_size(n, 64)
    assert copies <= np.ceil(n / block)
    assert block == vector_dedup.HELD // (12 * 64) or copies <= n**0.5 / 30


def test_repeated_queries(spark):
    """A repeated query row is one query; rows that share an id but no vector are two."""
    df = spark.createDataFrame([(20 + k, [1.0, float(k)], 0, 0) for k in range(30)], SCHEMA)
    twice = df.filter("vec_id = 20").unionByName(df.filter("vec_id = 20"))
    out = ann.nearest(df, twice).collect()
    assert len(out) == 20 and len({r.vec_id for r in out}) == 20
    other = twice.unionByName(spark.createDataFrame([(20, [0.0, 1.0], 5, 5)], SCHEMA))
    assert len(ann.nearest(df, other).collect()) == 40


def test_search_stops(spark):
    """On vectors without clusters the stopping test leaves a good part unverified."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    norm = float(np.sqrt((x * x).sum(axis=1)).max())
    directions = ann.projection(64)
    shard = ann.Shard(x, [[k] for k in range(3000)], ann.lifted(x, norm) @ directions)
    for k in range(40):
        p = np.r_[x[k], 0] @ directions
        shard.search(x[k], p, ann._distances(p[None], shard.low, shard.high)[0], k, norm, 20, ann.chi2_quantile(ann.P, ann.M), -np.inf)
    assert shard.verified < 0.85 * 40 * 3000


def loose_shard(n, queries, dim=64):
    """n vectors without clusters, and the batches in which a shard of them and its queries come."""
    rng = np.random.default_rng(3)
    x = vector_dedup.unit(rng.standard_normal((n, dim)))
    directions = ann.projection(dim)
    lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
    made = []
    for kind, rows, p in ((0, x, ann.lifted(x, 1.0) @ directions), (1, x[:queries], np.c_[x[:queries], np.zeros(queries)] @ directions)):
        m = len(rows)
        flat = [pa.array(np.full(m, v, np.int32)) for v in (0, 0, kind)]
        ids = pa.array([[k] for k in range(m)], pa.list_(pa.int64()))
        made.append(pa.RecordBatch.from_arrays([*flat, ids, lists(rows), lists(p), pa.array(np.full(m, -np.inf)), pa.array(np.arange(m))], names=list(ann._SENT)))
    return x, made


def test_queries_share_the_vectors_they_read(monkeypatch):
    """Vectors without clusters, where nearly all pairs must be verified: a shard's vectors are read once a block of queries, not once a query."""
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(self)[key]
            read.append(len(out))
            return out

    class Shard(ann.Shard):
        def __init__(self, *given):
            super().__init__(*given)
            self.x = self.x.view(Counted)

    monkeypatch.setattr(ann, "Shard", Shard)
    x, batches = loose_shard(8192, 512)
    found = pa.Table.from_batches(ann._searched(64, 1.0, 20, ann.chi2_quantile(ann.P, ann.M))(batches))
    assert 0 < sum(read) < 0.03 * 512 * 8192
    score = x[:512] @ x.T
    np.fill_diagonal(score, -np.inf)
    best = np.argpartition(score, -20, axis=1)[:, -20:]
    mine = set(zip(found["query"].to_pylist(), found["vec_id"].to_pylist(), strict=True))
    assert len(mine) == 20 * 512 and len(mine & {(q, int(v)) for q in range(512) for v in best[q]}) > 0.95 * len(mine)


def test_a_block_finds_what_its_queries_find_alone():
    """A query's scores do not depend on the queries beside it, nor do those that it finds alone get lost; equal scores go to the least ids."""
    x, _ = loose_shard(3000, 1)
    x[2000:2040], x[2040:2080] = x[5], np.eye(64)[0]
    x[2100:2140] = x[7] * (1 + np.arange(-40, 0)[:, None] * 1e-15)
    directions, stop = ann.projection(64), ann.chi2_quantile(ann.P, ann.M)
    shard = ann.Shard(x, [[k] for k in range(3000)], ann.lifted(x, 1.0) @ directions)
    q = np.r_[x[:100], np.eye(64)[:1]]
    p = np.c_[q, np.zeros(101)] @ directions
    far, own = ann._distances(p, shard.low, shard.high), [*range(100), -1]
    block = shard.search_block(q, p, far, own, 1.0, 20, stop, np.full(101, -np.inf))
    for k in range(101):
        alone = dict(zip(*reversed(shard.search(q[k], p[k], far[k], own[k], 1.0, 20, stop, -np.inf)), strict=True))
        scores, ids = block[k]
        assert len(ids) == 20 and sorted(zip((-s for s in scores), ids, strict=True)) == [(-s, i) for s, i in zip(scores, ids, strict=True)]
        last = (-scores[-1], ids[-1])
        assert all(alone[i] == s for i, s in zip(ids, scores, strict=True) if i in alone)
        assert all(i in ids for i, s in alone.items() if (-s, i) <= last)
    assert block[5][1] == list(range(2000, 2020)) and block[100][1] == list(range(2040, 2060))
    score = np.einsum("ij,j->i", x, x[7])
    score[7] = -np.inf
    assert block[7][1] == np.lexsort((np.arange(3000), -score))[:20].tolist()


def test_shards_grow_with_the_vectors():
    """Until a shard is as large as a worker may hold, no more shards, and so rows sent for a query, come of more vectors."""
    for n in (300_000, 600_000, 1_000_000):
        assert n / ann.shard_size(n, 64, 12) <= 17
    assert ann.shard_size(10**9, 64, 12) * 64 * 8 <= ann.HELD
    assert ann.shard_size(50_000, 64, 12) == ann.SHARD


def test_chi_square():
    assert ann.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    assert ann.chi2_cdf(18.307038, 10) == pytest.approx(0.95, abs=1e-6)
    assert ann.chi2_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)


@pytest.mark.parametrize(("shard", "leaves"), [(100, 64), (100_000, 64), (60, 2)])
def test_nearest(spark, monkeypatch, shard, leaves):
    """leaves 2: fewer shards than their size asks for, so that they are dealt out in pieces."""
    monkeypatch.setattr(ann, "SHARD", shard)
    own = ann.borders
    monkeypatch.setattr(ann, "borders", lambda points, n: own(points, min(n, leaves)))
    monkeypatch.setattr(ann, "VISITS", 20)
    rows = vectors()
    good = usable(rows)
    ids, x = np.array([i for _, i, _ in good]), np.array([v for *_, v in good])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = {i: v for _, i, v in good if i % 20 == 0}
    assert set(got) == set(queries)
    hit = 0
    for q, v in queries.items():
        s = x @ v
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] <= b[1] for a, b in zip(mine, mine[1:], strict=False))
        where = {i: k for k, i in enumerate(ids)}
        assert all(abs(x[where[i]] @ v - sc) < 1e-9 for _, i, sc in mine)
        hit += len({int(ids[k]) for k in best} & {i for _, i, _ in mine})
    assert hit >= 0.9 * 20 * len(queries)


def test_few_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0, 0), (21, [0.5, 0.5], 0, 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.filter("vec_id = 20")).collect()] == [(20, 1, 21)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).count() == 0 and vector_dedup.near_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None, 0, 0)], SCHEMA)
    assert ann.nearest(bad, bad).count() == 0 and [tuple(r) for r in vector_dedup.near_vectors(bad).collect()] == [(1, 0, 1, True)]
