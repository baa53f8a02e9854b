"""The rules of op7 as its contract lists them."""

from __future__ import annotations

import pytest

from prosemill.llm import urlfilter

CASES = [
    ("http://a.com/en/8", "com/en/", "block"),
    ("http://example.com/en/71", "example.com/en/7", "allow"),
    ("http://b.net/de/9", "net/de/", "allow"),
    ("http://example.net/de/9", "net/de/", "allow"),
    ("http://x.example.net/de/80", "example.net/de/8", "block"),
    ("http://c.org/es/1", "org/es/", "block"),
]


@pytest.mark.parametrize("bad", [False, True])
def test_every_rule_has_its_own_word(spark, bad):
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(CASES * 40)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(k, bad) for k in range(len(CASES) * 40)], "p bigint, bad boolean")
    got = {(r.page_id % len(CASES), r.rule, r.verdict) for r in urlfilter.judge_urls(pages, outcomes).collect()}
    assert got == {(k, rule, verdict) for k, (_, rule, verdict) in enumerate(CASES)}
