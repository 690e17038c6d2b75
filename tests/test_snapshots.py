"""Snapshots of a keyed cache against a dictionary, replays, and writers at the same time."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from labelspark.streaming import snapshots

SCHEMA = "k string, at int, v string"


def put(spark, root, rows, **more):
    return snapshots.merge(spark.createDataFrame(rows, SCHEMA), root, ["k"], ["at"], **{"buckets": 4} | more)


def state(spark, root, version=None):
    return sorted((tuple(r) for r in snapshots.snapshot(spark, root, version).collect()), key=str)


def test_equals_a_dictionary(spark, tmp_path):
    rng, root, want = random.Random(3), str(tmp_path), {}
    for _ in range(4):
        rows = [(rng.choice("abcdefgh") if rng.random() > 0.1 else None, rng.randrange(5), rng.choice("xyz")) for _ in range(12)]
        put(spark, root, rows)
        for k, at, v in sorted(rows, key=lambda r: r[1:]):
            if k not in want or want[k][0] <= at:
                want[k] = (at, v)
    assert state(spark, root) == sorted(((k, *r) for k, r in want.items()), key=str)
    assert snapshots.versions(spark, root) == [0, 1, 2, 3]


def test_null_order_is_least_and_earlier_snapshots_stay(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [("a", None, "first"), ("b", 1, None)])
    put(spark, root, [("a", 0, "second"), ("b", None, "late"), ("b", None, "late")])
    assert state(spark, root) == [("a", 0, "second"), ("b", 1, None)]
    assert state(spark, root, 0) == [("a", None, "first"), ("b", 1, None)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert put(spark, root, [("a", 1, "x")], batch=("s", 0)) == 0
    assert put(spark, root, [("a", 2, "y")], batch=("s", 1)) == 1
    assert put(spark, root, [("a", 9, "again")], batch=("s", 1)) == 1
    assert put(spark, root, [("b", 1, "z")], batch=("t", 0)) == 2
    assert state(spark, root) == [("a", 2, "y"), ("b", 1, "z")]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: put(spark, root, [(f"k{k}", 1, "v"), ("shared", k, f"v{k}")]), range(8)))
    assert sorted(got) == list(range(8))
    assert state(spark, root) == sorted([(f"k{k}", 1, "v") for k in range(8)] + [("shared", 7, "v7")])


def test_only_touched_buckets_are_written_and_old_ones_expire(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [(f"k{i}", 1, "v") for i in range(40)])
    before = snapshots.manifest(spark, root, 0)["buckets"]
    put(spark, root, [("k0", 2, "w")])
    after = snapshots.manifest(spark, root, 1)["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    put(spark, root, [("k0", 3, "u")])
    assert snapshots.expire(spark, root, 1) == 1
    assert snapshots.versions(spark, root) == [2] and len(state(spark, root)) == 40
    put(spark, root, [])
    assert len(state(spark, root)) == 40


def test_other_columns_are_refused(spark, tmp_path):
    put(spark, str(tmp_path), [("a", 1, "x")])
    with pytest.raises(ValueError):
        snapshots.merge(spark.createDataFrame([("a", 1)], "k string, at int"), str(tmp_path), ["k"], ["at"])
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, f"{tmp_path}/none")
