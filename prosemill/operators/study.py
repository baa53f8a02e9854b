"""Reader-study operators: stimuli checks, exclusions, assignment, evaluation of paired judgements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBMISSION = "schema_version int, received_at string, participant_id string, attention_check int, answers array<struct<item_id:string,condition:string,monotony:int,naturalness:int,readability:int,comprehension:int,elapsed_ms:bigint>>"
CONDITIONS = ("uniform", "varied", "control")


def first_byte(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int")


def ab_side(item: Column) -> Column:
    """A or B for an item, by its hash: the same on every run."""
    return F.when(first_byte(item) % 2 == 1, "B").otherwise("A")


def latin_condition(participant: Column, item_ix: Column) -> Column:
    """The condition of an item for a participant: rotated by the participant's hash."""
    return F.element_at(F.array(*map(F.lit, CONDITIONS)), ((first_byte(participant) + item_ix) % 3 + 1).cast("int"))


def exclusion_reasons(submissions: DataFrame, answer_key: DataFrame, items: int = 12) -> DataFrame:
    """participant_id, record and reasons (sorted as checked); an incomplete record has that reason only.

    ``submissions`` has a record number in order of arrival; ``answer_key`` item_id and correct.
    """
    fields = ("monotony", "naturalness", "readability", "comprehension", "elapsed_ms")
    long = submissions.select("record", "participant_id", "attention_check", F.size("answers").alias("n"), F.explode_outer("answers").alias("a"))
    joined = long.join(answer_key.select(F.col("item_id").alias("key_id"), "correct"), F.col("a.item_id") == F.col("key_id"), "left")
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f"a.{f}").isNull()
    by = joined.groupBy("record", "participant_id").agg(
        F.max("attention_check").alias("attention"),
        F.max("n").alias("n"),
        F.count_if(F.col("a.comprehension") == F.col("correct")).alias("right"),
        F.median("a.elapsed_ms").alias("time"),
        F.max(missing).alias("missing"),
        F.count_distinct("a.monotony").alias("d1"),
        F.count_distinct("a.naturalness").alias("d2"),
        F.count_distinct("a.readability").alias("d3"),
    )
    earlier = F.row_number().over(Window.partitionBy("participant_id").orderBy("record")) > 1
    checks = [
        (F.col("attention").isNull() | (F.col("attention") != 4), "attention_check"),
        (F.col("right") < items // 2, "comprehension_below_6"),
        (F.col("missing"), "missing_fields"),
        (F.coalesce(F.col("time"), F.lit(0)) < 10_000, "median_time_below_10s"),
        ((F.col("d1") <= 1) & (F.col("d2") <= 1) & (F.col("d3") <= 1), "straightlining_all_ratings"),
        (F.col("dup"), "duplicate_participant"),
    ]
    full = F.filter(F.array(*[F.when(c, r) for c, r in checks]), lambda x: x.isNotNull())
    short = F.filter(F.array(F.lit("incomplete"), F.when(F.col("dup"), "duplicate_participant")), lambda x: x.isNotNull())
    return by.withColumn("dup", earlier).select("participant_id", "record", F.when(F.col("n") != items, short).otherwise(full).alias("reasons"))


def valid_submission(c: str = "") -> Column:
    """Is a submission well formed: sizes, ranges and distinct items."""
    p = f"{c}." if c else ""
    answers = F.col(f"{p}answers")
    rating = lambda x: x.isNotNull() & x.between(1, 7)
    fine = lambda a: F.coalesce(a["condition"].isin(*CONDITIONS) & rating(a["monotony"]) & rating(a["naturalness"]) & rating(a["readability"]) & a["comprehension"].between(0, 2) & a["elapsed_ms"].between(1000, 1_800_000), F.lit(False))
    ids = F.transform(answers, lambda a: a["item_id"])
    conditions = F.transform(answers, lambda a: a["condition"])
    even = [F.size(conditions) - F.size(F.array_remove(conditions, k)) == 4 for k in CONDITIONS]
    return F.coalesce(F.length(f"{p}participant_id").between(16, 64) & F.col(f"{p}attention_check").between(1, 7) & (F.size(answers) == 12) & F.forall(answers, fine) & (F.size(F.array_distinct(ids)) == 12) & even[0] & even[1] & even[2], F.lit(False))


def stimuli_errors(metrics: DataFrame) -> DataFrame:
    """From (item, condition, chars, sentences, cv): item and error for every broken rule."""
    per = metrics.select("item", F.explode(F.filter(F.array(F.when(~F.col("sentences").between(8, 12), F.concat("condition", F.lit(": sentences"))), F.when(~F.col("chars").between(210, 320), F.concat("condition", F.lit(": chars")))), lambda x: x.isNotNull())).alias("error"))
    wide = metrics.groupBy("item").agg(F.max("chars").alias("hi"), F.min("chars").alias("lo"), F.count("*").alias("n"), F.max(F.when(F.col("condition") == "varied", F.col("cv"))).alias("v"), F.max(F.when(F.col("condition") == "uniform", F.col("cv"))).alias("u"))
    whole = wide.select("item", F.explode(F.filter(F.array(F.when(F.col("n") != 3, "conditions"), F.when(F.col("hi") > 1.10 * F.col("lo"), "length ratio"), F.when(F.coalesce(F.col("v") - F.col("u"), F.lit(0.0)) < 0.20, "cv gap")), lambda x: x.isNotNull())).alias("error"))
    return per.unionByName(whole)


def loss_rates(judgements: DataFrame) -> DataFrame:
    """From (doctype, winner of skill, baseline, tie): judged, lost and rate per doctype and overall (doctype null)."""
    return judgements.filter("winner is not null").groupingSets([[F.col("doctype")], []], "doctype").agg(F.count("*").alias("judged"), F.count_if(F.col("winner") == "baseline").alias("lost"), F.avg((F.col("winner") == "baseline").cast("double")).alias("loss_rate"))


def issue_clusters(issues: DataFrame, total_items: int) -> DataFrame:
    """From (item, file, section, kind, severity, sample): clusters by place with a score, highest first.

    Score: two per distortion plus 3, 2 or 1 by severity of findings, times the share of items.
    """
    weight = F.when(F.col("kind") == "distortion", 2).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    out = issues.groupBy("file", "section").agg(F.sum(weight).alias("w"), F.count_distinct("item").alias("items"), F.slice(F.array_sort(F.collect_set("sample")), 1, 3).alias("samples"))
    return out.select("file", "section", (F.col("w") * F.col("items") / total_items).alias("score"), "items", "samples").orderBy(F.desc("score"), "file", "section")


def manifest_errors(items: DataFrame) -> DataFrame:
    """From (id, doctype, mode, topic, source): id and error of every item that breaks a rule."""
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    errors = F.array(
        F.when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "id"),
        F.when(F.col("twice"), "duplicate id"),
        F.when(~F.coalesce(F.col("doctype").isin("minutes", "report", "guide", "memo", "slide"), F.lit(False)), "doctype"),
        F.when(~F.coalesce(F.col("mode").isin("generate", "rewrite"), F.lit(False)), "mode"),
        F.when((F.col("mode") == "generate") & F.col("topic").isNull(), "topic missing"),
        F.when((F.col("mode") == "rewrite") & F.col("source").isNull(), "source missing"),
    )
    return items.withColumn("twice", twice).select("id", F.explode(F.array_compact(errors)).alias("error"))


def supported(effect: Column, p: Column) -> Column:
    """The preregistered decision: an effect over zero with p under .05."""
    return F.coalesce((effect > 0) & (p < 0.05), F.lit(False))


def trigger_accuracy(cases: DataFrame) -> DataFrame:
    """From (set, should_trigger, triggered): cases and accuracy per set and over all (set null)."""
    right = (F.col("should_trigger") == F.col("triggered")).cast("double")
    return cases.groupingSets([[F.col("set")], []], "set").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.count_if("should_trigger").alias("positive"))


def truncated(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def json_in(text: Column, schema: str) -> Column:
    """An object in a reply: the text itself, else its fenced part, else from the first to the last brace."""
    parse = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    fenced, braces = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    usable = lambda c: F.when(F.get_json_object(c, "$").isNotNull() & F.trim(c).startswith("{"), parse(c))
    return F.coalesce(usable(text), usable(fenced), usable(braces))


def stratified_fold(key: Column, label: Column, k: int = 5) -> Column:
    """A fold from 0 to k - 1 by rank within the label: folds are even within classes and the same on every run."""
    return (F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key)) - 1) % k


def human_test(key: Column, label: Column, share: float = 0.2) -> Column:
    """Whether a human row (label 0) is of the fixed test part: ``share`` of them by rank of their hash, one at least; null for others."""
    human = label == 0
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    size = F.count("*").over(Window.partitionBy(label))
    return F.when(human, rank <= F.greatest(F.floor(size * share), F.lit(1)))


def leave_one_model_out(vectors: DataFrame, key: str = "doc_id", model: str = "model", features: str = "features", label: str = "label") -> DataFrame:
    """Scores of every machine model by a classifier of all others, with the same fifth of human rows in each test: adds ``held_out`` and ``score``."""
    split = vectors.withColumn("__test", human_test(F.col(key), F.col(label)))
    out = None
    for held in sorted(r[0] for r in vectors.filter(F.col(label) == 1).select(model).distinct().collect()):  # a row per model
        mine = F.when(F.col(label) == 1, F.col(model) == held).otherwise(F.col("__test"))
        scored = classifier_scores(split.withColumn("__fold", mine.cast("int")).drop("__test"), [1], features, label, "__fold")
        if scored is not None:
            scored = scored.drop("__fold").withColumn("held_out", F.lit(held))
            out = scored if out is None else out.unionByName(scored)
    return out


def classifier_scores(vectors: DataFrame, folds: list, features: str = "features", label: str = "label", fold: str = "fold") -> DataFrame:
    """Out-of-fold probabilities of a standardised, class-balanced logistic regression: one fit per fold value.

    Leave-one-model-out and leave-one-genre-out are the same with that column as the fold.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.withColumn("x", array_to_vector(F.col(features).cast("array<double>")))
    out = None
    for f in folds:
        train, test = data.filter(F.col(fold) != F.lit(f)), data.filter(F.col(fold) == F.lit(f))
        n = train.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
        if not n.p or n.p == n.n:
            continue
        weighted = train.withColumn("w", F.when(F.col(label) == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p))))
        model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol=label, weightCol="w", regParam=1.0 / n.n, maxIter=50)]).fit(weighted)
        scored = model.transform(test).select(*vectors.columns, F.element_at(vector_to_array("probability"), 2).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def grouped_ridge(answers: DataFrame, outcome: str, metrics: list[str], participant: str = "participant_id", item: str = "item_id", most: int = 10) -> DataFrame:
    """Per metric: mean over participant folds of the root mean square error of a ridge regression (penalty 1) on who, what and the standardised metric.

    Folds are whole participants, dealt by size; of a participant or item that
    training has not seen nothing is known. One group per metric and fold: the
    answers of a study, and normal equations of its participants and items.
    """
    sizes = answers.groupBy(participant).agg(F.count("*").alias("n"))
    folds = min(most, sizes.count())
    dealt = sizes.select(participant, ((F.row_number().over(Window.orderBy(F.desc("n"), participant)) - 1) % folds).alias("fold"))  # a row per participant
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    data = answers.join(dealt, participant).select(F.col(participant).cast("string").alias("who"), F.col(item).cast("string").alias("what"), F.col(outcome).cast("double").alias("y"), "fold", each.alias("m")).select("who", "what", "y", "fold", "m.*")
    rows = data.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        train, test = own[own.fold != key[1]], own[own.fold == key[1]]
        columns = [{v: k for k, v in enumerate(sorted(train[c].unique()))} for c in ("who", "what")]
        mean, sd = train.x.mean(), train.x.std(ddof=0) or 1.0

        def table(part: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(part), len(columns[0]) + len(columns[1]) + 1))
            for c, known, start in (("who", columns[0], 0), ("what", columns[1], len(columns[0]))):
                at = part[c].map(known)
                seen = at.notna().to_numpy()
                out[np.flatnonzero(seen), start + at[seen].astype(int).to_numpy()] = 1
            out[:, -1] = (part.x - mean) / sd
            return out

        x, y = table(train), train.y.to_numpy()
        middle = x.mean(0)
        weights = np.linalg.solve((x - middle).T @ (x - middle) + np.eye(x.shape[1]), (x - middle).T @ (y - y.mean()))
        error = test.y.to_numpy() - ((table(test) - middle) @ weights + y.mean())
        return pd.DataFrame({"metric": pd.Series([key[0]], dtype=object), "error": [float(np.sqrt((error**2).mean()))]})

    errors = rows.groupBy("metric", "held").applyInPandas(fit, "metric string, error double")
    return errors.groupBy("metric").agg(F.avg("error").alias("rmse")).select(F.lit(outcome).alias("outcome"), "metric", F.lit(folds).alias("grouped_cv_folds"), "rmse")
