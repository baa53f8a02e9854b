from __future__ import annotations

import numpy as np

from prosemill.llm import neardup


def test_stage_links_from_eighty(spark):
    """Two texts of 96 shingles with one word apart in two places: 86 of 106 shared, 0.811."""
    words = [f"w{k}" for k in range(100)]
    other = list(words)
    other[30], other[60] = "x", "y"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "one two three four five six")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in neardup.filter_near_duplicates(df).collect()) == [1, 3]


def test_branches_follow_the_threshold():
    nodes = np.arange(1, 200_001, dtype=np.uint64)
    for percent in (80, 85, 90):
        second = neardup._chosen(nodes, percent)[1] >= 0
        assert percent / 100 * (1 + second.mean()) > 1.01
