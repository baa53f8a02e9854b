"""Loaders, sweeps, matching and summaries against plain Python."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.operators import calibration as C
from prosemill.operators import metrics, semantic, study
from prosemill.plans import lint
from prosemill.rules.packs import JA
from prosemill.sources import documents as D
from prosemill.streaming import submissions


def cheapest(a, b):
    """Least total distance, by a table over both sides."""
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0] = 0
    for i in range(1, len(a) + 1):
        cost[i, 1:] = np.minimum.accumulate(cost[i - 1, :-1] + np.abs(a[i - 1] - b))
    return cost[len(a), len(b)]


def test_line_assignment_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 9))
        a, b = np.sort(rng.integers(0, 15, n)).astype(float), np.sort(rng.integers(0, 15, n + int(rng.integers(0, 6)))).astype(float)
        chosen = C.line_assignment(a, b)
        assert len(chosen) == n
        assert np.abs(a - b[chosen]).sum() == pytest.approx(cheapest(a, b)), (a, b)
    many = np.sort(rng.random(100_000))
    assert len(C.line_assignment(many[::3], many)) == len(many[::3])


@pytest.mark.parametrize("n", [0, 2, 3, 7, 60])
def test_percentile_of_pairs(n):
    m = np.random.default_rng(n).normal(size=(n, 4))
    values = [m[i] @ m[j] for i in range(n) for j in range(i + 2, n)]
    got = semantic.percentile_of_pairs(m, 95, block=8, bins=64)
    assert got == (pytest.approx((max(values), np.percentile(values, 95))) if values else (None, None))


def test_rank_columns_in_ranges(spark):
    rng = random.Random(2)
    p = [rng.choice([0.001, 0.02, 0.3]) if rng.random() < 0.3 else rng.random() for _ in range(700)]
    got = {r.k: r.q for r in C.benjamini_hochberg(spark.createDataFrame([*enumerate(p), (999, None)], "k int, p double")).collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    q, least = {}, 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        q[order[rank - 1]] = least
    least_of = {x: min(q[i] for i in range(len(p)) if p[i] == x) for x in p}
    assert got[999] is None
    assert all(got[i] == pytest.approx(least_of[x]) for i, x in enumerate(p))
    both = C.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("a", 0.04), ("b", 0.5)], "f string, p double"), "f")
    assert sorted((r.f, round(r.q, 9)) for r in both.collect()) == [("a", 0.02), ("a", 0.04), ("b", 0.5)]
    assert C.benjamini_hochberg(spark.createDataFrame([], "k int, p double")).count() == 0


def test_directed_sweep(spark):
    rows = [("m", float(v), True) for v in range(1, 41)] + [("m", v, False) for v in (0.0, 0.5, 39.5, 41.0, 42.0)] + [("none", None, True)]
    df = spark.createDataFrame(rows, "metric string, value double, is_base boolean")
    assert tuple(C.directed_sweep(df).first()) == ("m", 39.5, "high", 0.025, 0.6)
    low = C.directed_sweep(df, "low").first()
    assert (low.direction, low.fp_rate) == ("low", 0.025) and low.hit_rate == 0.4
    got = spark.range(1).select(C.count_verdict(F.lit(0.04), "notation"), C.count_verdict(F.lit(0.2), "notation"), C.count_verdict(F.lit(0.2), "punctuation"), C.verdict(F.lit(0.04), F.lit(0.2)), C.verdict(F.lit(0.04), F.lit(0.1))).first()
    assert tuple(got) == ("GO", "CONDITIONAL", "NO-GO", "GO", "NO-GO")


def test_modifier_order(spark):
    rows = [(1, 0, 5, 0, 2), (1, 0, 5, 2, 4), (1, 0, 5, 3, 1), (1, 0, 6, 5, 9), (1, 1, 3, 0, 4), (1, 1, 3, 1, 4), (2, 0, 1, 0, 1), (2, 0, 1, 2, 9)]
    got = metrics.modifier_order(spark.createDataFrame(rows, "doc_id int, sent int, head int, ix int, chars int")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 0.5)]


@pytest.fixture
def corpus(tmp_path):
    files = {"human/web/a.md": "web", "human/web/b.md": "biz", "human/aozora/c.txt": "classic", "human/web/d.md": "risky", "ai/gpt/business-1.md": "x", "ai/gpt/other.md": "y", "human/web/blank.md": " \n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "human/web/bad.md").write_bytes(b"\xff\xfe")
    meta = [{"id": "a", "genre": "tech", "quality": "high"}, {"id": "b", "genre": "business"}, {"id": "c", "register": "modern-colloquial-classic"}, {"id": "d", "quality": "high", "ai_era_risk": True}]
    (tmp_path / "sources.json").write_text(json.dumps(meta))
    return tmp_path


def test_corpus_groups(spark, corpus):
    docs, errors = D.read_texts(spark, str(corpus))
    sources = D.read_sources(spark, str(corpus / "sources.json"))
    assert sorted(r.error for r in errors.collect()) == ["blank", "not UTF-8"]
    assert sorted((r.doc_id, r.grp) for r in D.calibration_groups(docs, sources).collect()) == [("a", "human_web"), ("b", "human_business"), ("b", "human_web"), ("business-1", "ai"), ("business-1", "ai_business"), ("c", "human_aozora"), ("d", "human_web"), ("other", "ai")]
    assert sorted((r.doc_id, r.bucket, r.genre, r.model) for r in D.perplexity_buckets(docs, sources).collect()) == [("a", "human_high", "tech", None), ("b", "human_ordinary", "business", None), ("business-1", "ai:gpt", "business", "gpt"), ("c", "human_high", "essay", None), ("d", "human_high", "unknown", None), ("other", "ai:gpt", "unknown", "gpt")]
    assert sorted((r.doc_id, r.genre) for r in D.rhythm_humans(docs, sources).collect()) == [("a", "tech"), ("c", "essay")]
    assert sorted((r.doc_id, r.grp, r.model_or_source, r.genre, r.quality) for r in D.classifier_rows(docs, sources).collect())[:3] == [("ai/gpt/business-1", "ai", "gpt", "business", "n/a"), ("ai/gpt/other", "ai", "gpt", "unknown", "n/a"), ("human_aozora/c", "human", "aozora", "essay", "high")]
    docs, errors = D.read_texts(spark, str(corpus / "nowhere"))
    assert (docs.count(), [r.error for r in errors.collect()]) == (0, ["missing"])


def test_numbered_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    good, bad = D.numbered_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert [(r.line, r.a) for r in good.collect()] == [(1, 1), (4, 3)]
    assert [r.error.split("x.jsonl")[1] for r in bad.collect()] == [":3: malformed JSON"]


def test_page_lines(spark):
    rows = [("d", p, 1, "Running head") for p in range(4)] + [("d", p, 2, f" body {p} ") for p in range(4)] + [("d", 0, 3, "ページ 3/4"), ("d", 1, 3, " - 12 - "), ("d", 2, 3, "  ")]
    got = D.repeated_page_lines(spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string"))
    assert sorted(r.line for r in got.collect()) == [f"body {p}" for p in range(4)]
    assert D.markdown_table(spark.range(1500)).count("\n") == 1501


def test_refused_submissions(spark):
    answer = lambda k: {"item_id": f"i{k}", "condition": study.CONDITIONS[k % 3], "monotony": 3, "naturalness": 4, "readability": 5, "comprehension": 1, "elapsed_ms": 5000}
    record = lambda who, at, n=12: (1, at, who, 4, [answer(k) for k in range(n)])
    a, b, c = "a" * 20, "b" * 20, "c" * 20
    incoming = spark.createDataFrame([record(a, "2"), record(b, "1"), record(b, "2"), record(c, "1", 11)], study.SUBMISSION)
    fine, refused = submissions.admitted(spark.createDataFrame([(a,)], "participant_id string"), incoming)
    assert [(r.participant_id, r.received_at) for r in fine.collect()] == [(b, "1")]
    assert sorted((r.participant_id, r.received_at, r.reason) for r in refused.collect()) == [(a, "2", "duplicate"), (b, "2", "duplicate"), (c, "1", "malformed")]


def test_findings_json(spark):
    docs = lint.prepare(spark.createDataFrame([(1, "重要なのは速度。\n重要なのは精度。"), (2, "なし")], "doc_id int, text string"), JA)
    got = {r.doc_id: json.loads(r.json) for r in lint.findings_json(docs, lint.run_lint(docs, JA, categories=["forbidden_phrase"])).collect()}
    assert got[1]["count"] == 2 and got[1]["by_category"] == {"forbidden_phrase": 2} and [f["line"] for f in got[1]["findings"]] == [1, 2]
    assert got[2] == {"count": 0, "by_category": {}, "findings": []}
    assert "status" not in got[1]["findings"][0] and got[1]["findings"][0]["related_lines"] is None
    found = lint.run_lint(docs, JA, categories=["forbidden_phrase"]).withColumn("status", F.lit("new"))
    assert json.loads(lint.findings_json(docs, found).filter("doc_id = 1").first().json)["findings"][1]["status"] == "new"


def test_grouped_ridge(spark):
    rng = random.Random(1)
    rows = [(f"p{p}", f"i{i}", p % 3 + i * 0.5 + 2 * m + rng.gauss(0, 0.01), m, rng.random()) for p in range(8) for i in range(6) for m in [rng.random()]]
    got = {r.metric: r.rmse for r in study.grouped_ridge(spark.createDataFrame(rows, "participant_id string, item_id string, y double, good double, noise double"), "y", ["good", "noise"], most=4).collect()}
    y = np.array([r[2] for r in rows])
    folds = {p: k % 4 for k, p in enumerate(sorted({r[0] for r in rows}))}
    for metric, col in (("good", 3), ("noise", 4)):
        errors = []
        for f in range(4):
            train = [k for k, r in enumerate(rows) if folds[r[0]] != f]
            test = [k for k, r in enumerate(rows) if folds[r[0]] == f]
            people, things = sorted({rows[k][0] for k in train}), sorted({rows[k][1] for k in train})
            mean, sd = np.mean([rows[k][col] for k in train]), np.std([rows[k][col] for k in train], ddof=0)
            x = np.array([[*(rows[k][0] == q for q in people), *(rows[k][1] == q for q in things), (rows[k][col] - mean) / sd] for k in range(len(rows))], float)
            mx, my = x[train].mean(0), y[train].mean()
            w = np.linalg.solve((x[train] - mx).T @ (x[train] - mx) + np.eye(x.shape[1]), (x[train] - mx).T @ (y[train] - my))
            errors.append(np.sqrt(np.mean((y[test] - ((x[test] - mx) @ w + my)) ** 2)))
        assert got[metric] == pytest.approx(np.mean(errors), rel=1e-9)


def test_exact_p_values(spark):
    from itertools import combinations

    for m, n in ((1, 3), (3, 4), (4, 4), (2, 6)):
        every = [sum(r for r in c) - m * (m + 1) / 2 for c in combinations(range(1, m + n + 1), m)]
        for u in set(every):
            far = max(u, m * n - u)
            assert C.exact_mann_whitney(u, m, n) == pytest.approx(min(1.0, 2 * sum(x >= far for x in every) / len(every)))
    df = spark.createDataFrame([("k", float(v), v > 3) for v in range(6)] + [("t", 1.0, True), ("t", 1.0, False), ("t", 2.0, True)], "metric string, value double, is_ai boolean")
    got = {r.metric: r for r in C.rank_statistics(df).collect()}
    assert got["k"].p == pytest.approx(2 * 1 / 15) and got["k"].auc == 1.0
    assert 0 < got["t"].p <= 1


def test_rounded_and_score_sweeps(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(20, 3), True) for _ in range(80)] + [(rng.gauss(14, 3), False) for _ in range(80)] + [(30.04, None), (None, True)]
    got = C.rounded_sweep(spark.createDataFrame(rows, "value double, is_base boolean")).collect()
    base, ai = [v for v, b in rows if b and v is not None], [v for v, b in rows if b is False]
    marks = sorted({round(v, 1) for v, _ in rows if v is not None})
    assert len(got) == 2 * len(marks)
    for r in got:
        fits = (lambda v, t: v <= t) if r.direction == "low" else (lambda v, t: v >= t)  # noqa: B023
        assert r.fp_rate == pytest.approx(sum(fits(v, r.threshold) for v in base) / len(base))
        assert r.hit_rate == pytest.approx(sum(fits(v, r.threshold) for v in ai) / len(ai))
    low = [r for r in got if r.direction == "low"]
    assert [r.threshold for r in low if r.recommended] == [min((r for r in low if r.fp_rate < 0.05), key=lambda r: (-r.hit_rate, r.threshold)).threshold]
    scored = spark.createDataFrame([(0.1, 0), (0.6, 0), (0.7, 1), (0.96, 1)], "score double, label int")
    assert [round(r.hit_rate, 2) for r in C.score_sweep(scored).sort("threshold").collect()][-3:] == [0.5, 0.5, 0.5]


def test_leave_one_model_out(spark):
    rng = random.Random(4)
    rows = [(k, ("a", "b", None)[k % 3], [rng.gauss(2 if k % 3 < 2 else 0, 0.5), rng.random()], int(k % 3 < 2)) for k in range(60)]
    got = study.leave_one_model_out(spark.createDataFrame(rows, "doc_id int, model string, features array<double>, label int")).collect()
    assert {(r.held_out, r.model) for r in got} == {("a", "a"), ("a", None), ("b", "b"), ("b", None)}
    assert len([r for r in got if r.label == 0]) == 2 * 4 and len([r for r in got if r.held_out == "a" and r.label == 1]) == 20
    assert sum((r.score > 0.5) == (r.label == 1) for r in got) > 0.9 * len(got)


def test_reports(spark):
    from prosemill.operators import outline
    from prosemill.plans import reports

    docs = lint.prepare(spark.createDataFrame([(1, "# 題\n重要なのは速度。\n重要なのは精度。"), (2, "なし")], "doc_id int, text string"), JA)
    found = lint.run_lint(docs, JA, categories=["forbidden_phrase"])
    got = {r.doc_id: r.report for r in reports.lint_reports(docs, found).collect()}
    assert got[1].startswith("=== lint: 1 ===\nfindings: 2\n  - forbidden_phrase: 2\n\n[info] L2 (forbidden_phrase)\n    重要なのは速度。")
    assert got[2] == "=== lint: 2 ===\nfindings: 0\n\nnone"
    assert "[new] [info] L2" in {r.doc_id: r.report for r in reports.lint_reports(docs, found.withColumn("status", F.lit("new"))).collect()}[1]
    assert reports.outline_reports(outline.outline(docs, JA)).filter("doc_id = 1").first().report == "L1: # 題\nL2:     重要なのは速度"
    assert reports.term_reports(spark.createDataFrame([(1, "A", 2, 0, 3, True), (1, "B", 1, 0, 1, False)], "doc_id int, term string, first_line int, place int, count int, has_gloss_hint boolean")).first().report == "L1 B x1\nL2 A* x3"
    text = reports.evaluation_report(spark.createDataFrame([("memo", 2, 1, 0.5)], "doctype string, judged int, lost int, loss_rate double"), spark.createDataFrame([("f", 1.0)], "file string, score double"))
    assert "## Loss rates" in text and "| memo | 2 | 1 | 0.5 |" in text and "## Issue clusters" in text


def test_stimuli_and_perplexity(spark):
    from prosemill.operators import morphemes

    docs = lint.prepare(spark.createDataFrame([(1, "アアア。\nアアアアア。")], "doc_id int, text string"), JA)
    got = metrics.stimulus_metrics(morphemes.attach_approximate(docs)).first()
    assert (got.characters, got.sentences, got.mora_mean, got.mora_sd, got.mora_cv) == (11, 2, 4.0, 1.0, 0.25)
    rows = [(1, None, 2.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 20.0), (1, 4, float("nan")), (2, 1, float("inf"))]
    got = {r.doc_id: r for r in metrics.perplexity_summary(spark.createDataFrame(rows, "doc_id int, line int, loss double")).collect()}
    assert (got[1].doc_perplexity, got[1].n, got[1]["mean"]) == (pytest.approx(np.exp(2)), 2, pytest.approx((1 + np.e) / 2))
    assert (got[2].doc_perplexity, got[2].n) == (None, 0)


def test_values_fire_as_the_detectors_do(spark):
    from prosemill.operators import morphemes
    from prosemill.plans import sweeps
    from prosemill.rules.packs import DEFAULT

    rng = random.Random(8)
    pieces = ["価値の本質を考える", "しかし東京で三月に働く", "速度ではなく精度だ", "会社の計画が続く", "可能性と重要性", "また例えば5人が学ぶ", "カタカナ語が増える", "それは品質を示す"]
    rows = []
    for k in range(24):
        own = pieces[: 2 + k % 6]
        rows.append((k, "\n\n".join("".join(rng.choice(own) * rng.choice([1, 1, 2]) + "。" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60)))))
    docs = morphemes.attach_approximate(lint.prepare(spark.createDataFrame(rows, "doc_id int, text string"), JA))
    found = {}
    for r in lint.run_lint(docs, JA, experimental=True, categories=[*sweeps.SWEEPS, "low_lexical_diversity"]).select("doc_id", "category").distinct().collect():
        found.setdefault(r.category, set()).add(r.doc_id)
    defaults = {"low_burstiness": DEFAULT.burstiness, "high_length_autocorrelation": DEFAULT.autocorrelation, "low_sentence_variance": DEFAULT.variance_cv, "nominal_ending": DEFAULT.nominal_ratio, "paragraph_lead_conjunction": DEFAULT.conjunction_ratio, "uniform_paragraph_structure": DEFAULT.uniform_cv, "antithesis_repetition": DEFAULT.antithesis_min, "repeated_sentence_lead": DEFAULT.lead_repeat, "repeated_syntax_template": DEFAULT.template_ratio, "low_lexical_diversity_ttr": DEFAULT.ttr, "low_lexical_diversity_mtld": DEFAULT.mtld, "low_specificity": DEFAULT.specificity}
    fires = {"lt": lambda v, t: v < t, "gt": lambda v, t: v > t, "le": lambda v, t: v <= t, "ge": lambda v, t: v >= t}
    said = {}
    for r in sweeps.detector_values(docs, JA).collect():
        if r.value is not None and fires[sweeps.SWEEPS[r.metric][2]](r.value, defaults[r.metric]):
            said.setdefault(r.metric, set()).add(r.doc_id)
    assert said == found
    assert len(found) >= 6


def test_genres_of_one_kind_have_no_pair(spark):
    rows = [(1, "a", 10, 1.0, True), (2, "a", 12, 2.0, False), (3, "b", 10, 1.0, True), (4, None, 9, 1.0, False), (5, "a", 11, None, True)]
    got = C.matched_pairs(spark.createDataFrame(rows, "doc_id int, genre string, n_chars int, value double, is_ai boolean")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, 1.0, 2.0)]
