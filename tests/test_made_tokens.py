"""Tokens made in place equal those of analyser rows, without a row for each morpheme."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill import queries
from prosemill.operators import morphemes
from prosemill.plans import lint
from prosemill.rules.packs import LATIN

FIELDS = ("surface", "pos0", "pos1", "dict_form", "reading", "begin", "end")
TEXTS = [(1, "A bb ccc.  Dddd eeeee! \n\n`x` ff gg. ?\nlast line"), (2, ""), (3, " \n"), (4, "# Title\nÉa ü. one")]


def test_made_tokens(spark):
    p = lint.prepare(spark.createDataFrame(TEXTS, "doc_id int, text string"), LATIN)
    words = "filter(split(s.masked, ' '), x -> x <> '')"
    each = p.select("doc_id", F.posexplode("sentences").alias("sent_ix", "s")).select("doc_id", F.col("s.line").alias("line_no"), "sent_ix", F.posexplode(F.expr(words)).alias("ix", "w"))
    rows = each.select("doc_id", "line_no", "sent_ix", "ix", F.expr(queries.SURFACE).alias("surface"), F.expr(queries.TAG).alias("pos0"), F.lit("*").alias("pos1"), F.col("w").alias("dict_form"), F.col("w").alias("reading"), F.lit(0).alias("begin"), F.lit(0).alias("end"))
    made = morphemes.attach_made(p, words, dict(zip(FIELDS, (queries.SURFACE, queries.TAG, "'*'", "w", "w", "0", "0"), strict=True)))
    kept = lambda df: df.orderBy("doc_id").select("doc_id", "tokens", "paragraph_tokens").collect()
    assert kept(made) == kept(morphemes.attach_precomputed(p, rows))


def test_analysed_is_narrow(spark):
    plan = queries.analysed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan


def test_detectors_run_once_in_a_sweep(spark):
    plan = queries.QUERIES["detector_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1


def test_made_texts_are_made_once(spark):
    plan = queries.ja_prepared(spark, "/root/testdata/sf0.001").select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and not any("replace(" in x for x in plan.splitlines() if "Filter" in x)


def test_masking_hands_back_pieces(spark):
    import pyarrow as pa

    from prosemill.functions import text as T

    rows = ["`a` b" + "x" * T.MASKED_PIECE, None, "# h", "plain"] * 2
    found = list(T.markdown_masker().func(iter([pa.array(rows, pa.string()), pa.array([], pa.string())])))
    assert len(found) == 3
    assert [x for p in found for x in p.to_pylist()] == ["    b" + "x" * T.MASKED_PIECE, None, "", "plain"] * 2
