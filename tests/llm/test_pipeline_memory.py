"""The pipeline's finding of round 2."""

import corpus_pipeline
from parchmint.llm import common


def test_driver_gives_memory_back(spark, monkeypatch):
    assert common.trimmed(spark)
    calls = []
    monkeypatch.setattr(corpus_pipeline, "collected_garbage", lambda s: calls.append(s))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, f: d), ("two", lambda s, d, f: d)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 2
