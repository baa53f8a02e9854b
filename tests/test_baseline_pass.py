"""A baseline's two runs are told apart in one pass, without a second reading and a join."""

from __future__ import annotations

import os

import pytest

from prosemill import queries
from prosemill.plans import lint

DATA = "/root/testdata/sf0.001"


def test_sides_pair_as_two_runs(spark):
    rows = [(1, 0, "c", "one  two", 0), (1, 1, "c", "onetwo", 0), (1, 2, "c", "on etwo", 1), (None, 0, "c", None, 0), (None, 3, "c", "", 1), (2, 0, None, "x", 0), (2, 0, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id int, ix int, category string, excerpt string, side int")
    got = sorted(map(tuple, lint.baseline_diff(df.filter("side = 0"), df.filter("side = 1")).collect()), key=str)
    want = [(1, "c", "one  two", "persisting"), (1, "c", "onetwo", "new"), (None, "c", "", "persisting"), (2, None, "x", "new"), (2, None, "x", "resolved")]
    assert got == sorted(want, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_baseline_takes_one_pass(spark):
    plan = queries.QUERIES["baseline_diff"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
