"""Every stage of the pipeline, and the operators without odd-row tests of their own, on nulls, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemill.llm import quality, shared, warc

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, kept string, component_id string, n_words int, __text string"
CLEAN = {k: " ".join(f"{w}{(k * 7 + i) % 41}" for i, w in enumerate(("the house of water and light was old " * 6).split())) for k in range(12)}
PASSAGE = " ".join(f"secret{k}" for k in range(15))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def rows():
    out = [(k, t, "en", "s") for k, t in CLEAN.items()] + [(0, CLEAN[0], "en", "s"), (None, CLEAN[1] + " more words", None, None), (20, None, "en", None), (21, "", None, "s"), (22, "short", "en", "s"), (23, "# | $ " * 40, None, "s"), (24, "again and again and again " * 60, "en", "s"), (25, CLEAN[2] + " end", "en", "s"), (26, CLEAN[3] + " " + PASSAGE, "en", "s"), (27, " ".join(f"word{i} of{i * 31}" for i in range(60_000)), None, "s")]
    return [(i, t, lang, s, None if t is None else len(t), "c", "c", "c", 0, "c") for i, t, lang, s in out]


def stage(name):
    return dict(pipeline.STAGES)[name]


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = stage("quality rules")(spark, docs, folder)
    assert first.columns == docs.columns
    assert not {20, 21, 22, 24} & set(ids(first)) and {*CLEAN, None, 25, 26, 27} <= set(ids(first)) and ids(first).count(0) == 2
    second = stage("language ID")(spark, docs, folder)
    assert second.columns == docs.columns and not {20, 21} & set(ids(second)) and {*CLEAN, None, 25, 26} <= set(ids(second))
    third = stage("near duplicates")(spark, docs, folder)
    assert third.columns == docs.columns
    assert ids(third) == sorted([*CLEAN, None, 20, 21, 22, 23, 24, 26, 27], key=str)
    fourth = stage("decontamination")(spark, docs, folder)
    assert fourth.columns == docs.columns and ids(fourth) == sorted([r[0] for r in rows() if r[0] != 26], key=str)
    last = stage("tokens")(spark, docs, folder)
    assert last.count() == len(rows()) and last.filter("ids is null").count() == 1
    assert last.filter("doc_id <> 20").filter("not round_trip").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_an_empty_table(spark, folder, name):
    assert stage(name)(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_run_on_odd_rows(spark, folder):
    spark.createDataFrame(rows(), SCHEMA).drop("__text").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = ids(pipeline.run(spark, folder))
    assert got == sorted([*CLEAN, None, 27], key=str)


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b\na b"), (1, "a b\na b"), (None, None), (2, "x " * 300_000)], "doc_id bigint, text string").withColumn("n_words", F.lit("c")).withColumn("base_failed", F.lit("c"))
    got = sorted(((r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score_quality(df).collect()), key=str)
    assert got == sorted([(1, 4, 1, 0, True), (1, 4, 1, 0, True), (None, 0, 0, 0, True), (2, 300_000, 0, 300_000, True)], key=str)


def test_archives_of_odd_rows(spark):
    rows = [(5, "u", "same", "c"), (5, "u", "same", "c"), (4, "v", "same", "c"), (None, None, "same", "c"), (6, None, None, "c"), (7, "w", "y" * 1_000_000, "c")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")).collect()), key=str)
    assert got == sorted([(5, 4, "response", None), (5, 4, "response", None), (4, 4, "revisit", 5), (None, 4, "revisit", 5), (6, 0, "response", None), (7, 1_000_000, "response", None)], key=str)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
