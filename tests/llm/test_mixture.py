"""The mixture in the pipeline's own result."""

from collections import Counter

import corpus_pipeline
from labelspark.llm import mixing
from labelspark.llm.queries import WEIGHTS

SF = "/root/testdata/sf0.001"


def test_written_order_is_found_again(spark, tmp_path):
    """Files of unequal length, which Spark deals out longest first."""
    rows = [(k, f"t{k}" * (1 + 200 * (k > 700)), "abc"[k % 3]) for k in range(1000)]
    df = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 3, "b": 1}, 4)
    want = [r.doc_id for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 3, "b": 1}, 4).orderBy("position").collect()]
    split = df.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    for k, (written, expected) in enumerate([(df, want), (split, sorted(want))]):
        written.write.parquet(str(tmp_path / str(k)))
        out = mixing.with_position(spark.read.parquet(str(tmp_path / str(k))))
        assert [(r.position, r.doc_id) for r in sorted(out.collect(), key=lambda r: r.position)] == list(enumerate(expected))


def test_shares_of_the_result(spark, monkeypatch, tmp_path):
    """Each prefix of whole blocks of run()'s result has its sources' shares but for less than one block, until a source runs out; src0 is hot."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("mixing sources", "byte-level BPE")])
    source = dict(enumerate(s for s, w in sorted(WEIGHTS.items()) for _ in range(100 * w)))
    spark.createDataFrame([(k, f"text {k}", s) for k, s in source.items()], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted((r.position, source[r.doc_id]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [p for p, _ in out] == list(range(len(source)))
    totals, had, period, held = Counter(source.values()), Counter(), sum(WEIGHTS.values()), 0
    for k, (_, s) in enumerate(out, 1):
        had[s] += 1
        if not all(had[x] + mixing.BLOCK <= totals[x] for x in WEIGHTS):
            break
        if k % mixing.BLOCK == 0:
            held += 1
            assert all(abs(had[x] - k * w / period) < mixing.BLOCK for x, w in WEIGHTS.items())
    assert held > 100
