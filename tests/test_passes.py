"""Queries that read a document's columns once: no second pass, join or pushed-down filter."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from prosemill import queries
from prosemill.functions.text import ustrip

DATA = "/root/testdata/sf0.001"


def test_strip_equals_the_regular_expression(spark):
    rows = [(f"{chr(c)}{chr(c)}a{chr(c)} b{chr(c)}",) for c in range(1, 0x3100)] + [("",), (" 　\n",), ("a\n\n",), (None,)]
    x = spark.createDataFrame(rows, "x string").select("x", F.expr(ustrip("x")).alias("a"), F.expr("regexp_replace(x, '(?U)^\\\\s+|\\\\s+$', '')").alias("b"))
    assert x.filter("not a <=> b").count() == 0
    assert "regexp" not in ustrip("x")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["sentence_variance", "uniform_paragraphs_ja", "rhythm_metrics"])
def test_one_pass(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    assert not [x for x in plan.split("+- ") if x.startswith("Filter") and "lambda" in x]
