"""text_similarity on texts that differ only after character 2000."""

import difflib

from labelspark.plans.catalogue import QUERIES


def test_whole_texts(spark, tmp_path):
    head = " ".join(f"word{k}" for k in range(400))
    texts = {"a": (head + " same end", head + " same end"), "b": (head + " left" * 300, head + " right" * 300), "c": (head, head + " and more" * 500), "d": ("x" * 2500 + "abc", "y" * 2500 + "abc"), "e": (None, head)}
    assert all(t[:2000] == head[:2000] for s in "abc" for t in texts[s])
    rows = [(2 * k + i, t, s) for k, (s, pair) in enumerate(texts.items()) for i, t in enumerate(pair)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source: r.ratio for r in QUERIES["text_similarity"](spark, str(tmp_path)).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x or "", y or "").ratio()
    assert set(got) == set(texts)
    for s, (x, y) in texts.items():
        assert min(abs(got[s] - ratio(x, y)), abs(got[s] - ratio(y, x))) < 1e-12
    assert got["b"] < 1 and got["c"] < 1
