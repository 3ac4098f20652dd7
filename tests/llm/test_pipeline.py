import os

import pytest

import corpus_pipeline
from glossweave.llm.common import written
from tests.oracle import DATA


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    before, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, f"{DATA}/sf0.001"), name)
        assert docs.columns == before
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        assert len(left) > 100
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    run = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert sorted(map(tuple, run.select("doc_id", "start", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length").collect()))
