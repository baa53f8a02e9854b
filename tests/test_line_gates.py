"""Lines are told by a character class before a pattern reads them, and ends by two characters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemill.functions.text import quoted, spans, stripped, ustrip
from prosemill.operators import detectors as D
from prosemill.operators import metrics as M
from prosemill.plans import lint
from prosemill.rules.packs import JA, LATIN

LINES = ["", "it was that, This is not only the one of the two", "able to a able to the", "de la de lade la x", "これは重要なのは示すことができる。ではなく、だけでなく今も", "at(b) a|b [x] abc ac xyx"]
ODD = ["a|b", "ab?c", "(a|)b", "(a|b)+c", "(x)y\\1", "[(]b", "(?i)AB", "a{0}b", "x(?=y)", "(a(b|c))", "^a", "\\(b"]


def test_starts():
    assert D.starts("(is|was) (of|that)") == {"is ", "was "} and D.starts("de la .{0,20}") == {"de "}
    assert D.starts("ab?c") == {"a"} and D.starts("(a|)bcd") == {"abcd", "bcd"}
    assert all(D.starts(p) == {""} for p in ("a|b", "(?i)ab", "[ab]c", "a?b", ".{0,20}x", "^a", "(a(b|c))"))


@pytest.mark.parametrize("patterns", [LATIN.calques, LATIN.antithesis, LATIN.inanimate, JA.calques, JA.antithesis, JA.inanimate, ODD])
def test_sped_patterns_match_the_same(spark, patterns):
    x = spark.createDataFrame([(t,) for t in LINES], "x string")
    for p in patterns:
        assert x.filter(F.expr(f"not {spans('x', p)} <=> {spans('x', D.sped(p))}")).count() == 0, p
    any_ = "|".join(f"(?:{p})" for p in patterns if "\\1" not in p)
    assert x.filter(F.expr(f"(x rlike {quoted(any_)}) <> (x rlike {quoted(D.sped(*[p for p in patterns if '\\1' not in p]))})")).count() == 0


def test_literal_phrases(spark):
    phrases = ["a|b", "[x]", "at(b)", "c.", "de la", "$", "\\"]
    x = spark.createDataFrame([(t,) for t in [*LINES, "cost $1", "c.d", "a\\b"]], "x string")
    assert x.filter(F.expr(f"(x rlike {quoted(D.sped(*map(D.literal, phrases)))}) <> exists({D.words(phrases)}, p -> contains(x, p))")).count() == 0


def test_stripped_equals_ustrip(spark):
    rows = [([f"{chr(c)} a{chr(c)}", f" {chr(c)}", f"é{chr(c)} ", f"b {chr(c)}é "],) for c in range(1, 0x3100)] + [(["", " ", "𠮷 ", "　𠮷"],)]
    x = spark.createDataFrame(rows, "x array<string>")
    assert x.filter(F.expr(f"not {stripped('x')} <=> transform(x, y -> {ustrip('y')})")).count() == 0


def test_readability_of_texts_with_and_without_japanese(spark):
    docs = spark.createDataFrame([(1, "しかし、今、雨。また雪。A b."), (2, "One. Two."), (3, "ア。しかし")], "doc_id int, text string")
    out = M.readability(lint.prepare(docs, JA), JA)
    got = {r.doc_id: (r.comma_density, round(r.conjunction_rate, 6)) for r in out.collect()}
    assert got == {1: (round(2 / 3, 16), round(2 / 3, 6)), 2: (0.0, 0.0), 3: (0.0, 0.5)}
    assert ">=" in out.select("conjunction_rate")._jdf.queryExecution().optimizedPlan().toString()
