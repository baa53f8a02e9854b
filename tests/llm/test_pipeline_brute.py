"""The whole pipeline against plain Python on the smallest driver tables."""

from __future__ import annotations

import os
import re
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from prosemill.llm import langid, neardup, quality, spm
from prosemill.llm import textops as T

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_arrays import brute_pooled, brute_quality  # noqa: E402
from test_operators import ALNUM, LOWER, NONSPACE, brute_links  # noqa: E402

DATA = "/root/testdata/sf0.001"


def passes_quality(text):
    rules, x = quality.QualityRules(), text or ""
    m, w = brute_quality(x), NONSPACE.findall(x)
    if m["n_words"] < rules.min_words or 100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]:
        return False
    size = max(m["word_chars"], 1)
    for n, share in rules.gram_shares.items():
        count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = {k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        if sum(len(w[k]) for k in hit) > share * size:
            return False
    return m["dup_line_chars"] <= rules.line_share * size and m["n_symbols"] <= rules.symbol_share * size


def windows_of(items):
    out = set()
    for t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        out |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    return out


def contaminated(text, windows):
    w = ALNUM.findall((text or "").translate(LOWER))
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_pipeline_equals_plain_python(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    first = {k: t for k, t in docs.items() if passes_quality(t)}
    model = langid.fit(table.filter(table.doc_id.isin(*first)))

    def language(text):
        if not re.search(r"[^\W\d_]", text or ""):
            return False
        short = len(text.encode()) <= 600
        p = brute_pooled(model, text) if short else model.pooled(T.texts(pa.array([text])))[0]
        return p.max() >= model.rules.min_score

    second = {k: t for k, t in first.items() if language(t)}
    linked = brute_links(list(second.items()), neardup.STAGE_PERCENT)
    third = {k: t for k, t in second.items() if linked[k][2]}
    windows = windows_of(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    fourth = {k: t for k, t in third.items() if not contaminated(t, windows)}
    assert len(docs) > len(first) > len(third) > len(fourth) > 0
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    got = {r.doc_id: r for r in pipeline.run(spark, DATA).collect()}
    assert got.keys() == fourth.keys()
    for k, t in fourth.items():
        assert got[k].ids == lib.encode(t) and got[k].n_tokens == len(got[k].ids) and got[k].round_trip
