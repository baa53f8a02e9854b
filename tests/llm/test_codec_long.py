"""Long cuts and odd rows of the codec."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from prosemill.llm import spm
from prosemill.llm import textops as T

sentencepiece = pytest.importorskip("sentencepiece")
RNG = random.Random(9)
LONG = [" " * 3001, "-" * 2047, "a" * 1500, base64.b64encode(RNG.randbytes(3000)).decode(), "日本語" * 900, "x" + " " * 700 + "y" + "-" * 800, "".join(RNG.choice("abcdefgh") for _ in range(4000)), "🦄" * 600]


@pytest.mark.parametrize("segment", [64, 1 << 18])
def test_long_cuts_equal_the_library(segment):
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    codec = spm.Codec(spm.Vocabulary.load())
    codec.SEGMENT = segment
    for long in (16, 512, 1 << 30):  # the waves over all cuts give the same
        codec.LONG = long
        codec._forget()
        ids, bounds = codec.encode(T.texts(pa.array(LONG)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [lib.encode(x) for x in LONG]


@pytest.mark.parametrize("text", [" " * 200_000, "-" * 200_000, "a" * 200_000, "".join(RNG.choice("abcdefghijkl") for _ in range(300_000)), "日" * 300_000])
def test_time_is_linear(text):
    codec = spm.Codec(spm.Vocabulary.load())
    began = time.time()
    ids, _ = codec.encode(T.texts(pa.array([text])))
    data, _ = codec.decode(ids, np.array([0, len(ids)]))
    assert bytes(data).decode() == text
    assert time.time() - began < 20


def test_odd_rows(spark):
    rows = [(1, "one text"), (1, "one text"), (None, "of no one"), (2, None), (3, ""), (4, "word " * 100_000)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id bigint, text string, ids string, round_trip string")
    held = spm.codec(df)
    found = spm.encode(df, held)
    back = sorted(((r.doc_id, r.text) for r in spm.decode(found, held).collect()), key=str)
    assert back == sorted(rows, key=str)
    assert {r.doc_id: r.round_trip for r in found.collect()} == {1: True, None: True, 2: False, 3: True, 4: True}
