"""Stored scorers, evaluation by folds, token budgets, sketches and late rows."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.operators import evaluation, scoring, sketches, summary
from loamsift.sources import scorers
from loamsift.streaming import late, streams
from suite import flow_queries, views
from tests.conftest import SF_DIR

LABELS = fixed.LABELS_MODEL


@pytest.fixture(scope="module")
def taught(spark):
    """Rows whose words tell their label."""
    rows = [(i, f"{LABELS[i % 5]} words of row {i}", LABELS[i % 5]) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, text string, label string").cache()


def train(df):
    return scoring.train_classifier(df.select("text", "label"), features=1 << 8, max_iter=8)


def test_stored_scorer_scores_as_the_fitted_one(spark, taught, tmp_path):
    path = str(tmp_path / "s")
    model = train(taught)
    assert not scorers.has_scorer(spark, path)
    scorers.save_scorer(model, LABELS, path, spark)
    loaded = scorers.load_scorer(spark, path)
    assert loaded.labels == LABELS
    columns = ["row_id", "predicted_label", "confidence"]
    want = scoring.score_with_model(taught, model).select(columns).orderBy("row_id").collect()
    assert loaded(taught).select(columns).orderBy("row_id").collect() == want


def test_names_come_from_the_stored_config(spark, taught, tmp_path):
    path = str(tmp_path / "s")
    names = tuple(f"class {x}" for x in LABELS)
    scorers.save_scorer(train(taught), names, path, spark)
    got = scorers.load_scorer(spark, path)(taught)
    assert {r[0] for r in got.select("predicted_label").distinct().collect()} == set(names)
    assert set(got.first()["confidences"]) == set(names)


def test_mismatches_are_refused(spark, taught, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="5 classes for 6"):
        scorers.save_scorer(train(taught), (*LABELS, "more"), path, spark)
    scorers.save_scorer(train(taught), LABELS, path, spark)
    swapped = tmp_path / "other.json"
    swapped.write_text(scorers.config_text((LABELS[1], LABELS[0], *LABELS[2:])))
    with pytest.raises(ValueError, match="not those"):
        scorers.load_scorer(spark, path, str(swapped))
    torn = tmp_path / "torn.json"
    torn.write_text(json.dumps({"labels": {"a": 1, "b": 0}, "id2label": {"0": "a", "1": "b"}}))
    with pytest.raises(ValueError, match="two maps"):
        scorers.load_scorer(spark, path, str(torn))
    torn.write_text(json.dumps({"labels": {"a": 1}, "id2label": {"1": "a"}}))
    with pytest.raises(ValueError, match="count from 0"):
        scorers.load_scorer(spark, path, str(torn))
    other = train(taught.where("row_id < 100"))
    signature = json.loads((tmp_path / "s" / "signature.json").read_text())
    other.write().overwrite().save(f"{path}/model-{signature['folder']}")  # other weights under the old name
    with pytest.raises(ValueError, match="weights"):
        scorers.load_scorer(spark, path)
    assert os.path.exists(f"{path}/signature.json")


def test_folds_predict_every_row_once_without_it(spark, taught, tmp_path):
    seen = []

    def spy(df):
        seen.append({r["text"] for r in df.collect()})
        return train(df)
    got = evaluation.cross_predictions(taught, 3, spy, scoring.score_with_model, path=str(tmp_path / "p"))
    rows = got.join(taught.select("row_id", "text"), "row_id").collect()
    assert len(rows) == 200 == len({r["row_id"] for r in rows}) and {r["fold"] for r in rows} == {0, 1, 2}
    assert all(r["text"] not in seen[r["fold"]] for r in rows)
    report = evaluation.evaluate(got).collect()
    assert report[0]["accuracy"] > 0.9 and report[0]["majority"] == 0.2
    assert sum(r["support"] for r in report) == 200


def test_a_constant_model_does_not_beat_the_majority(spark, taught):
    constant = taught.withColumn("predicted_label", F.lit("bug"))
    report = evaluation.evaluate(constant).collect()
    assert len(report) == 5 and report[0]["accuracy"] == report[0]["majority"] == 0.2
    by = {r["label"]: r for r in report}
    assert by["bug"]["recall"] == 1.0 and by["bug"]["precision"] == 0.2 and by["question"]["f1"] == 0.0


# --- token budgets ---
@pytest.mark.parametrize("budget", [1, 50, 400, 10 ** 6])
def test_budgeted_batches_give_the_same_logits(spark, budget):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("x" * int(k) for k in rng.integers(1, 9, int(n)))) for i, n in enumerate(
        rng.lognormal(2, 1.2, 300))] + [(300, ""), (301, None)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)

    def load():
        def model(batch):
            assert len(batch) == 1 or batch.fillna("").str.split().str.len().clip(1, 384).max() * len(batch) <= budget
            return np.stack([[len(t or ""), (t or "").count("x")] for t in batch])
        return model
    tokens = scoring.word_tokens(384)
    got = scoring.with_logits(df, F.col("t"), load, 2, budget=budget, tokens=tokens).collect()
    assert len(got) == 302
    for r in got:
        assert r["logits"] == [len(r["t"] or ""), (r["t"] or "").count("x")]


def test_length_order_saves_padding():
    lengths = np.random.default_rng(1).lognormal(4, 1, 5000).astype(int).clip(1, 384)
    by_row, by_length = (scoring.token_batches(lengths, 16 * 384, by_length=x) for x in (False, True))
    for batches in (by_row, by_length):
        assert sorted(np.concatenate(batches).tolist()) == list(range(5000))
        assert all(len(b) * lengths[b].max() <= 16 * 384 for b in batches)
    padded = [scoring.padded_tokens(lengths, b) for b in (by_row, by_length)]
    assert padded[1] < 1.05 * lengths.sum() < 1.5 * lengths.sum() < padded[0]
    assert scoring.token_batches(np.array([], int), 5) == []
    assert scoring.word_tokens(3)(pd.Series(["a b c d", None, "", " a "])).tolist() == [3, 1, 1, 1]


# --- sketches ---
def test_sketches_of_parts_stay_within_their_rank_error(spark, tmp_path):
    rng = np.random.default_rng(9)
    sizes = rng.lognormal(4, 1, 6000).astype(int)
    df = spark.createDataFrame([(i, "w " * int(n), None if i % 50 == 0 else "a b") for i, n in enumerate(sizes)],
                               "i int, body string, title string")
    stats = sketches.WordStats(spark, str(tmp_path / "w"))
    assert stats.word_stats().count() == 0
    for part in range(7):
        assert stats.add(df.where(F.col("i") % 7 == part), ("title", "body"), f"p{part}")
    assert not stats.add(df, ("title", "body"), "p3")
    got = {r["column"]: r for r in stats.quantiles(0.05, 0.5, 0.95).collect()}
    exact = {r["column"]: r for r in summary.word_stats(df, "title", "body").collect()}
    for column in ("title", "body"):
        assert got[column]["n"] == 6000 and abs(got[column]["mean_words"] - exact[column]["mean_words"]) < 1e-9
        assert (got[column]["min_words"], got[column]["max_words"]) == (
            exact[column]["min_words"], exact[column]["max_words"])
    ordered = np.sort(sizes)
    for rank in (0.05, 0.5, 0.95):
        value = got["body"][f"q{rank:g}"]
        assert (ordered < value).mean() - 0.015 <= rank <= (ordered <= value).mean() + 0.015


# --- late rows ---
def test_late_rows_are_kept_and_correct_the_trend(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    events = views.table(spark, SF_DIR, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"),
        F.col("value").alias("confidence"), "event_id")
    mid = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    old = F.unix_micros("ts") <= mid
    held = old & (F.col("event_id") % 5 == 0)
    schema = "ts timestamp, label string, confidence double"

    def land(rows):
        rows.drop("event_id").write.mode("append").parquet(folder)
        late.intake(streams.file_stream(spark, folder, schema), out, ck).awaitTermination()
    land(events.where(old & ~held))
    assert late.late_rows(spark, out).count() == 0
    land(events.where(~old | held).union(spark.sql("SELECT NULL, 'bug', 1.0, 1")))
    rows = {tuple(r) for r in late.corrected(spark, out).collect()}
    assert rows == {tuple(r) for r in streams.confidence_trend(events).collect()}
    newest = events.where(old & ~held).agg(F.max(F.unix_micros("ts"))).first()[0]
    hour = 3_600_000_000
    want = events.where(held & (F.floor(F.unix_micros("ts") / hour) * hour + hour <= newest - hour)).count()
    assert late.late_rows(spark, out).count() == want > 0
    n = late.trend(spark, out).agg(F.sum("n")).first()[0]
    assert n == events.count() - want
    again = f"{out}-again"  # a replay of all batches into the same table adds nothing
    late.intake(streams.file_stream(spark, folder, schema), again, ck + "2").awaitTermination()
    assert {tuple(r) for r in late.corrected(spark, again).collect()} == rows


def test_a_fit_reads_every_text_once(spark, taught):
    reads = spark.sparkContext.accumulator(0)

    def counted(text):
        reads.add(1)
        return text
    rows = taught.withColumn("text", F.udf(counted)("text"))
    assert train(rows).stages[-1].numClasses == 5
    assert reads.value == 200
    with pytest.raises(ValueError, match="features"):
        scoring.train_classifier(scoring.count_terms(taught, 1 << 7), features=1 << 8)


def test_folds_by_stored_terms_are_those_by_texts(spark, taught, tmp_path):
    terms = scoring.count_terms(taught, 1 << 8).drop("text")

    def fit(df):
        return scoring.train_classifier(df, features=1 << 8, max_iter=8)
    by_text = evaluation.cross_predictions(taught, 3, fit, scoring.score_with_model, path=str(tmp_path / "t"))
    by_terms = evaluation.cross_predictions(terms, 3, fit, scoring.score_with_model, path=str(tmp_path / "s"),
                                            inputs=("label", scoring.TERMS))
    key = ["row_id", "fold", "label", "predicted_label"]
    assert sorted(by_text.select(key).collect()) == sorted(by_terms.select(key).collect())


def _texts(spark, tmp_path):
    rows = [(i // 2 if i < 6 else None if i == 6 else i, f"text {i}", "de" if i % 2 else None, "s", i)
            for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_training_rows_of_repeated_and_null_ids_are_those_of_the_join(spark, tmp_path):
    got = flow_queries._training_rows(spark, _texts(spark, tmp_path)).collect()
    name = {None: "question", "de": "documentation"}
    docs = [(r["doc_id"], r["lang"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = [(a, name[lang]) for a, _ in docs for b, lang in docs if a is not None and a == b]
    assert sorted((r["row_id"], r["label"]) for r in got) == sorted(want)


def test_training_texts_are_not_shuffled(spark, tmp_path):
    frame = flow_queries._training_rows(spark, _texts(spark, tmp_path))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan  # the other rows of repeated ids, a stored narrow table
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "hashpartitioning" not in physical
