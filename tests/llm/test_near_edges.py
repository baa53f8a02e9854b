"""Near duplicates: ids, repeated rows, clashing columns, and a large cluster in blocks."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from prosemill.llm import neardup
from prosemill.llm.neardup import filter_near_duplicates, link_classes

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"z{k}" for k in range(60))


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, LONG, "A"), (1, LONG, "B"), (None, LONG, "C"), (None, LONG, "C"), (2, LONG + " more", "D"), (3, OTHER, "E"), (3, OTHER, "E"), (4, None, "F"), (4, None, "F"), (5, "", None)]
    df = spark.createDataFrame([(i, t, x, "c", "c", {"k": 1}) for i, t, x in rows], "doc_id bigint, text string, src string, component_id string, rep string, kept map<string,int>")
    got = sorted({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in link_classes(df).collect()}, key=str)
    assert got == sorted([(1, 56, 1, True), (None, 56, None, True), (2, 57, 1, False), (3, 56, 3, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    assert link_classes(df).count() == len(rows)
    kept = filter_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.src) for r in kept.collect()), key=str) == sorted([(1, "A"), (None, "C"), (None, "C"), (3, "E"), (4, "F"), (5, None)], key=str)


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(7, LONG), (7, OTHER), (8, LONG + " x"), (9, OTHER + " y"), (10, "a b c d e f")], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in link_classes(df).collect()}
    assert got == {(7, 56): 7, (8, 57): 7, (9, 57): 7, (10, 2): 10}


def test_ids_that_cannot_name_a_class(spark):
    with pytest.raises(ValueError, match="integer"):
        link_classes(spark.createDataFrame([("a", LONG)], "doc_id string, text string"))
    assert link_classes(spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id int, text string")).filter("component_id = 1").count() == 2


def test_a_cluster_in_blocks_keeps_its_pairs(spark):
    clusters = spark.createDataFrame([(1, k) for k in range(40)] + [(2, k) for k in range(5)], "cluster bigint, rep bigint")
    met = set()
    sizes = []
    for group in neardup._dealt(clusters, "cluster", 12).groupBy("cluster").agg({"rep": "collect_set"}).collect():
        sizes.append(len(group[1]))
        met |= {(a, b) for a in group[1] for b in group[1] if a < b}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert max(sizes) < 40 and len(sizes) > 10


def test_blocks_change_no_class(spark, monkeypatch):
    from test_operators import brute_links, near_copies

    items = list(enumerate(near_copies(120)))
    df = spark.createDataFrame(items, "doc_id int, text string")
    monkeypatch.setattr(neardup._dealt, "__defaults__", (16,))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in link_classes(df).collect()}
    assert got == brute_links(items)


def test_a_bitmap_of_keys(spark):
    keys = spark.range(0, 3000, 3).toDF("node")
    bitmap = neardup._Bitmap(keys)
    import pyarrow as pa

    assert all(bitmap.may_have(pa.array(range(0, 3000, 3))).to_pylist())
    assert sum(bitmap.may_have(pa.array(range(10**6, 10**6 + 3000))).to_pylist()) < 300
    assert not any(neardup._Bitmap(keys.limit(0)).may_have(pa.array(range(100))).to_pylist())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert filter_near_duplicates(df).count() == link_classes(df).count() == 0
