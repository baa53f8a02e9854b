from __future__ import annotations

import os

import pytest

from prosemill.llm import neardup, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "decontamination", "tokens"]
    kept = quality.filter_quality(docs)
    unique = neardup.filter_near_duplicates(kept)
    out = pipeline.run(spark, DATA)
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in unique.collect()}
    assert len(ids) > docs.count() * 0.6
    assert "n_tokens" in out.columns
