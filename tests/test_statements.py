"""Insert statements against a loop over all rows."""

import random

import pytest

from labelspark.plans import statements


def looped(rows):
    """Numbers of rows of the statements, filled one after another."""
    out, size = [], 0
    for r in rows:
        if out and (size + len(r) > statements.MOST_CHARS or out[-1] >= statements.MOST_ROWS):
            out.append(0)
            size = 0
        elif not out:
            out.append(0)
        out[-1] += 1
        size += len(r) + 2
    return out


def shapes():
    rng = random.Random(2)
    yield "short", [""] * 1350
    yield "long then short", ["x" * 24_000] * 3 + [""] * 900 + ["y" * 30_000] + [""] * 3
    yield "alternating", ["x" * (9000 if k % 2 else 10) for k in range(700)]
    yield "mixed", ["x" * rng.choice([0, 5, 120, 130, 2000, 26_000]) for _ in range(2500)]
    yield "near the limit", ["x" * (25_000 // 5 - 12 + k % 3) for k in range(600)]
    yield "one", ["it's"]
    yield "none", []


@pytest.mark.parametrize(("name", "texts"), list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_statements(spark, monkeypatch, name, texts):
    monkeypatch.setattr(statements, "BLOCK", 256)
    monkeypatch.setattr(statements, "FAN", 2)
    rows = [(7 * k + 3, t, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string, n int").repartition(3)
    out = sorted(map(tuple, statements.insert_batches(df, "tab", "id").collect()))
    lines = ["({}, '{}', NULL)".format(i, t.replace("'", "''")) for i, t, _ in rows]
    want, at = [], 0
    for k, n in enumerate(looped(lines)):
        want.append((k, n, "INSERT INTO tab (id, t, n) VALUES\n" + ",\n".join(lines[at : at + n]) + ";"))
        at += n
    assert out == want
    assert all(n <= 200 and (n == 1 or len(s) <= 25_100) for _, n, s in out)
