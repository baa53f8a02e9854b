from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest

from prosemill.llm import queries, spm

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_query_and_stage_return_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = queries.QUERIES["op1_sentencepiece"](spark, DATA)
    assert "ids" in rows.columns
    assert dict(pipeline.STAGES)["tokens"](spark, docs, DATA).columns == rows.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = {r.doc_id: r.text for r in spm.decode(rows, spm.codec(docs)).collect()}
    for r in rows.collect():
        assert r.n_tokens == len(r.ids or ())
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids or (), "<i4").tobytes()).hexdigest()
        assert r.round_trip == (back[r.doc_id] == texts[r.doc_id])
