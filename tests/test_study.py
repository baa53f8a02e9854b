from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from prosemill.operators import calibration, metrics, study
from prosemill.sources import documents
from prosemill.streaming import submissions


def submission(name: str, record: int = 0, attention: int = 4, ratings=(1, 2, 3), right: bool = True, ms: int = 15_000, n: int = 12) -> dict:
    answers = [{"item_id": f"i{k}", "condition": study.CONDITIONS[k % 3], "monotony": ratings[k % len(ratings)], "naturalness": ratings[(k + 1) % len(ratings)], "readability": ratings[(k + 2) % len(ratings)], "comprehension": 0 if right else 1, "elapsed_ms": ms} for k in range(n)]
    return {"schema_version": 1, "received_at": "t", "participant_id": name.ljust(16, "x"), "attention_check": attention, "answers": answers, "record": record}


def frame(spark, rows):
    return spark.createDataFrame(rows, study.SUBMISSION + ", record int")


def test_exclusions(spark):
    key = spark.createDataFrame([(f"i{k}", 0) for k in range(12)], "item_id string, correct int")
    rows = [submission("good"), submission("bad", 1, attention=3, ratings=(4,), right=False, ms=5000), submission("short", 2, n=11), submission("good", 3)]
    got = {(r.participant_id.rstrip("x"), r.record): r.reasons for r in study.exclusion_reasons(frame(spark, rows), key).collect()}
    assert got["good", 0] == []
    assert got["bad", 1] == ["attention_check", "comprehension_below_6", "median_time_below_10s", "straightlining_all_ratings"]
    assert got["short", 2] == ["incomplete"]
    assert got["good", 3] == ["duplicate_participant"]


def test_validation(spark):
    wrong = submission("b")
    wrong["answers"][0]["condition"] = "other"
    got = frame(spark, [submission("a"), wrong, submission("c", n=11)]).select(study.valid_submission().alias("v")).collect()
    assert [r.v for r in got] == [True, False, False]


def test_assignment_is_even_and_fixed(spark):
    rows = spark.range(12).select(study.latin_condition(F.lit("someone"), F.col("id").cast("int")).alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in rows) == [4, 4, 4]


def test_stream_refuses_duplicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[submission("a"), submission("b", n=3)], [submission("a"), submission("c")]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r | {"client_ip": "10.0.0.1"}) for r in rows))
    q = submissions.append(submissions.read_submissions(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.participant_id[0] for r in out.collect()) == ["a", "c"]
    assert "client_ip" not in out.columns


def test_stimuli(spark):
    rows = [("x", "uniform", 250, 9, 0.1), ("x", "varied", 255, 9, 0.5), ("x", "control", 252, 9, 0.3), ("y", "uniform", 100, 9, 0.3), ("y", "varied", 250, 20, 0.4), ("y", "control", 250, 9, 0.3)]
    got = study.stimuli_errors(spark.createDataFrame(rows, "item string, condition string, chars int, sentences int, cv double")).collect()
    assert {(r.item, r.error) for r in got} == {("y", "uniform: chars"), ("y", "varied: sentences"), ("y", "length ratio"), ("y", "cv gap")}


def test_rank_statistics_equal_pairs(spark):
    a, h = [1.0, 3.0, 3.0, 5.0], [2.0, 3.0, 4.0]
    df = spark.createDataFrame([("m", x, True) for x in a] + [("m", x, False) for x in h], "metric string, value double, is_ai boolean")
    delta = sum((x > y) - (x < y) for x in a for y in h) / (len(a) * len(h))
    row = calibration.rank_statistics(df).first()
    assert row.cliffs_delta == pytest.approx(delta)
    assert row.auc == pytest.approx((delta + 1) / 2)
    assert 0 < row.p <= 1


def test_bands_in_sweep(spark):
    rows = [("m", v, True) for v in (4.0, 5.0, 5.0, 6.0) * 10] + [("m", v, False) for v in (0.0, 10.0) * 5]
    got = calibration.exhaustive_sweep(spark.createDataFrame(rows, "metric string, value double, is_base boolean"), bands=True).first()
    assert (got.direction, got.hit_rate, got.fp_rate) == ("band", 1.0, 0.0)


def test_matched_pairs_are_cheapest(spark):
    rows = [(1, "g", 100, 1.0, True), (2, "g", 400, 2.0, True), (3, "g", 90, 3.0, False), (4, "g", 200, 4.0, False), (5, "g", 390, 5.0, False)]
    got = calibration.matched_pairs(spark.createDataFrame(rows, "doc_id bigint, genre string, n_chars int, value double, is_ai boolean"))
    assert {(r.ai_doc, r.human_doc) for r in got.collect()} == {(1, 3), (2, 5)}
    assert calibration.wilcoxon(got, "genre").first().n == 2


def test_classifier_folds(spark):
    rows = [([float(k % 2 + k / 100), float(k % 3)], k % 2, k % 3) for k in range(60)]
    out = study.classifier_scores(spark.createDataFrame(rows, "features array<double>, label int, fold int"), [0, 1, 2]).collect()
    assert len(out) == 60
    assert sum((r.score > 0.5) == (r.label == 1) for r in out) >= 55


def test_sources(spark, tmp_path):
    (tmp_path / "ai" / "m1").mkdir(parents=True)
    (tmp_path / "ai" / "m1" / "essay-1.md").write_text("---\nid: e\ngenre: essay\n---\n\n本文")
    (tmp_path / "w.md").write_text("text")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    good, bad = documents.read_texts(spark, str(tmp_path))
    assert [r.error for r in bad.collect()] == ["not UTF-8"]
    meta = spark.createDataFrame([("w", "web", "high")], "id string, type string, quality string").selectExpr("id", "type", "quality", "cast(null as string) genre", "cast(null as string) register", "cast(null as boolean) ai_era_risk")
    got = {r.doc_id: (r.grp, r.genre, r.model) for r in documents.grouped_corpus(good, meta).collect()}
    assert got == {"essay-1": ("ai", "essay", "m1"), "w": ("fp_base", "unknown", None)}
    row = good.filter("doc_id = 'essay-1'").select(documents.front_matter(F.col("text"), "genre"), documents.body_of(F.col("text"))).first()
    assert tuple(row) == ("essay", "本文")


def test_running_heads(spark):
    rows = [("d", p, 1, "Title") for p in range(1, 5)] + [("d", p, 2, f"body {p}") for p in range(1, 5)] + [("d", p, 3, f"- {p} -") for p in range(1, 5)]
    got = documents.repeated_page_lines(spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string"))
    assert {r.line for r in got.collect()} == {f"body {p}" for p in range(1, 5)}


def test_external_metrics(spark):
    chunks = spark.createDataFrame([(1, 0, k, k + d, "nsubj") for k, d in enumerate([1, 2, 3, 4, 10])], "doc_id int, sent int, ix int, head_ix int, dep string")
    row = metrics.dependency_metrics(chunks).first()
    assert (row.mean, row.far_share) == (4.0, 0.2)
    losses = spark.createDataFrame([(1, 0.0), (1, 100.0)], "doc_id int, loss double")
    assert tuple(metrics.perplexity_summary(losses).first()) == (1, 1, 1.0, 0.0)


def test_json_in_replies(spark):
    rows = [('{"a": 1}',), ("x ```json\n{\"a\": 2}\n``` y",), ('so {"a": 3} it is',), ("none",)]
    got = spark.createDataFrame(rows, "t string").select(study.json_in(F.col("t"), "a int").alias("j")).collect()
    assert [r.j.a if r.j else None for r in got] == [1, 2, 3, None]


def test_manifest_and_decision(spark):
    rows = [("a", "memo", "generate", "t", None), ("a", "memo", "rewrite", None, None), ("b c", "x", "other", None, None)]
    got = {(r.id, r.error) for r in study.manifest_errors(spark.createDataFrame(rows, "id string, doctype string, mode string, topic string, source string")).collect()}
    assert got == {("a", "duplicate id"), ("a", "source missing"), ("b c", "id"), ("b c", "doctype"), ("b c", "mode")}
    row = spark.range(1).select(study.supported(F.lit(0.1), F.lit(0.01)).alias("a"), study.supported(F.lit(0.1), F.lit(None).cast("double")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_subgroups(spark):
    df = spark.createDataFrame([("h", "b"), ("h", None)], "grp string, subgroup string")
    assert sorted(r.grp for r in calibration.with_subgroups(df).collect()) == ["b", "h", "h"]
