"""The trie of conversation prefixes against dictionaries of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from labelspark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(v)] for c, v in convs.items()}


def trunc(c, n):
    return (abs(c) % n) * (1 if c >= 0 else -1)


def regrown(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - trunc(c, 5), [])[:h] + own[h:]
    return out


def trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    leaves = {p: int(not kids[p]) for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def table(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def cases(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(60), 205, 206, 1004, -3, -7, 10**15]:
        for t in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["user", "assistant", "", None]), rng.choice(["a", "b", "é漢", "", None])))
    rows += [(c, 0, "user", "the same") for c in range(300, 360)]
    rows += [(500, k, "user", f"long {k}") for k in range(700)] + [(501, k, "user", f"long {k}") for k in range(500)]
    return rows + rows[:5] + [(None, 1, "user", "nobody's"), (None, None, None, None)]


def test_trie_of_own_turns(spark, monkeypatch):
    """Conversations as they are, and long ones; chunks of few ids."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = cases(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    got = prefix_trie.prefix_trie(prefix_trie.turns(df))
    assert table(got) == trie(ordered(rows))
    # no more rows are exploded than there are prefixes
    assert got.agg({"n_convs": "sum"}).first()[0] == sum(len(t) + 1 for t in ordered(rows).values())


def test_regrown_trie(spark):
    for seed in (2, 3):
        rows = cases(seed)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
        assert table(prefix_trie.trie_report(df)) == trie(regrown(ordered(rows)))


def test_masses_that_end_in_one_node(spark):
    """A third of all conversations are equal, and some have no turns left."""
    rows = [(c, t, "user", "hi" if c % 3 == 0 else f"{c} {t}") for c in range(3000) for t in range(2)]
    convs = ordered(rows)
    got = table(prefix_trie.prefix_trie(prefix_trie.turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))))
    assert got == trie(convs)
    ids = spark.range(3100).selectExpr("id AS conv_id")
    got = table(prefix_trie.prefix_trie(prefix_trie.turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)), ids))
    assert got == trie(convs | {c: [] for c in range(3000, 3100)})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_report(df).collect() == [] and prefix_trie.prefix_trie(prefix_trie.turns(df)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = table(queries.QUERIES["op13_prefix_trie"](spark, sf))
    assert got == trie(regrown(ordered(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = con.sql(queries.ORACLES["op13_prefix_trie"])
    assert sorted(sql.columns) == sorted(COLUMNS) and sorted(sql.select(*COLUMNS).fetchall(), key=str) == got
