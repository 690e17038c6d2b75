"""Registered queries without SQL, and the pipeline, over whole given tables against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as tokens
import pytest
from test_near_copies import alike, shingle_set
from test_texts import slow_components, slow_fingerprint

import corpus_pipeline
from labelspark.llm import bpe, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def scores(spark):
    return queries.op9_quality(spark, SF).collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def digests(text):
    own, _ = bpe.encoding(tokens.path(queries.RANKS), tokens.PATTERN)
    ids = own.encode_ordinary(text or "")
    return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(text or "")


def statistics(t):
    """The twelve statistics of a text, in the model's order."""
    t = t or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    count = lambda marks: sum(c in marks for c in t)
    found = [float(np.log1p(len(words))), share(len(t) - len(words), len(words)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(len(words), len(lines))]
    found += [share(count(m), len(words)) for m in ("|", "%#$&*@^~=<>{}[]_\\+", "!?")] + [share(count(m), len(t)) for m in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    return found + [share(count(m), len(words)) for m in (".;:", ",")]


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_search(spark):
    """Every score is that of the original vectors, every query has its neighbours in order, and nine of ten are the nearest."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding is not None and all(e is not None and np.isfinite(e) for e in r.embedding) and any(r.embedding)}
    got: dict = {}
    for r in queries.op1_nearest_vectors(spark, SF).collect():
        assert r.vec_id != r.query_id and abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    asked = [q for q in x if q % 20 == 0]
    assert sorted(got) == sorted(asked)
    right = 0
    for q in asked:
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, min(20, len(x) - 1) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        nearest = sorted((-(x[q] @ v), k) for k, v in x.items() if k != q)[: len(mine)]
        right += len({k for _, k in nearest} & {k for *_, k in mine})
    assert right >= 0.9 * sum(map(len, got.values()))


def test_tokens(spark, documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, SF).collect()}
    assert got == {d: digests(t) for d, t in documents.items()}


def test_fingerprints(spark, documents):
    fps = {d: slow_fingerprint(t) for d, t in documents.items()}
    root = slow_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least: dict = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {d: (f"{f:016x}", least[root[f]]) for d, f in fps.items()}


def test_scores(spark, documents, scores):
    """Rules fitted on statistics computed here, read one by one for every document."""
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    rows = sorted((d, q, *statistics(documents[d])) for d, q in labels if q in (0, 1) and d in documents and not held(d))
    model = quality.fit_rules(np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float), quality.STATISTICS)
    assert model.rules and {r.doc_id for r in scores} == set(documents)
    for r in scores:
        own, total = statistics(documents[r.doc_id]), model.bias
        for weight, rule in zip(model.weights, model.rules, strict=True):
            total += weight * all((own[k] > border) == above for k, above, border in rule.terms)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
        assert r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5)


def test_pipeline_digests(spark, documents, scores):
    """run() against the stages in plain Python: documents kept, tokens, digests of ids and texts, positions without gaps."""
    texts = {r.doc_id: documents[r.doc_id] or "" for r in scores if r.score >= 0.5}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first: dict = {}
    for d in sorted(texts):
        for x in texts[d].split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), d)
    texts = {d: "\n".join(x for x in t.split("\n") if first.get(key(x), d) == d) for d, t in texts.items()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = slow_components(set(texts), lambda a, b: alike(sets[a], sets[b]))
    least: dict = {}
    for d in sorted(texts):
        least.setdefault(root[d], d)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == {d: digests(texts[d]) for d in least.values()}
    assert sorted(r.position for r in out) == list(range(len(out)))
