import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import scores
from loamsift.operators import scoring
from loamsift.plans import score as scoreplan
from loamsift.sources import readers
from loamsift.streaming import streams
from suite import flow_queries, views  # noqa: F401
from suite.registry import QUERIES
from tests.conftest import SF_DIR

LABELS = fixed.LABELS_MODEL


def test_softmax_argmax_and_decode(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0, 0.0, -1000.0]), (1, [1000.0, 0.0, 0.0, 0.0, 0.0])],
                               "i int, l array<double>")
    rows = scoring.decode_logits(df, "l", LABELS).orderBy("i").collect()
    e = np.exp(np.array([1, 3, 3, 0, -1000]) - 3.0)
    want = [round(float(x) * 100, 1) for x in e / e.sum()]
    assert rows[0]["predicted_label"] == LABELS[1]  # first maximum
    assert [rows[0]["confidences"][x] for x in LABELS] == want
    assert rows[1]["confidence"] == 100.0 and rows[1]["color"] == fixed.PALETTE[0]


def test_unknown_label_is_grey(spark):
    df = spark.createDataFrame([("bug",), ("else",), (None,)], "label string")
    got = [r[0] for r in df.select(scores.label_color(F.col("label"), LABELS)).collect()]
    assert got == [fixed.PALETTE[0], "#888", "#888"]


def test_wrong_label_count_is_refused(spark):
    df = spark.createDataFrame([("x",)], "t string")
    bad = scoring.with_logits(df, F.col("t"), lambda: lambda s: np.zeros((len(s), 3)), 5)
    with pytest.raises(Exception, match="3 scores for 5 labels"):
        bad.collect()


def test_pair_text(spark):
    df = spark.createDataFrame([(" t ", " b\n"), ("t", "  "), ("t", None), (None, "b")],
                               "title string, body string")
    assert [r[0] for r in df.select(scoring.pair_text()).collect()] == ["t b", "t", "t", " b"]


def test_upload_flow_with_the_default_model(spark, tmp_path):
    rows = [(f"{label} words {i}", f"{label} body", label) for label in LABELS for i in range(8)]
    train = spark.createDataFrame(rows, "title string, body string, label string").withColumn(
        "text", scoring.pair_text())
    model = scoring.train_classifier(train.select("text", "label"), features=1 << 10, max_iter=10)
    upload = train.select("title", "body", F.lit(7).alias("extra"))
    out = scoreplan.score_upload(upload, lambda d: scoring.score_with_model(d, model), max_rows=40)
    got = out.collect()
    assert len(got) == 40 and all(r["title"].startswith(r["predicted_label"]) for r in got)
    assert out.columns[:5] == ["title", "body", "extra", "predicted_label", "confidence_%"]
    with pytest.raises(ValueError):
        scoreplan.score_upload(upload, lambda d: d, max_rows=39)
    with pytest.raises(ValueError):
        scoring.score_with_model(train, model, LABELS + ("refactor",))
    one = scoring.score_record(spark, "bug words", None, lambda d: scoring.score_with_model(d, model))
    assert one.first()["predicted_label"] == "bug"
    log = scoring.log_entries(one, "single", F.lit("ann"))
    tables = scoreplan.analytics(log)
    assert tables["sources"].first()["single_count"] == 1


def land(spark, folder, parts=5):
    """Given events as several files, in time order."""
    events = views.table(spark, SF_DIR, "events")
    top = events.agg(F.max("event_id")).first()[0] + 1
    for i in range(parts):
        lo, hi = top * i // parts, top * (i + 1) // parts
        events.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode(
            "append").parquet(folder)
    return events


def test_exact_intake_over_many_batches_and_restart(spark, tmp_path):
    folder, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    events = land(spark, folder)

    def run(opened=None):
        s = streams.file_stream(spark, folder, events.schema, max_files=1)
        streams.exact_intake(s, out, ck, "value", ["event_id"], buckets=16, opened=opened).awaitTermination()
        return streams.intake_rows(spark, out, events.schema)
    opened = []
    got = run(opened)
    assert len(opened) == 5 and opened[0] == []
    first = events.groupBy("value").agg(F.min("event_id").alias("event_id"))
    want = {tuple(r) for r in first.collect()}
    assert {tuple(r) for r in got.select("value", "event_id").collect()} == want
    assert got.count() == len(want) < events.count()
    events.limit(50).write.mode("append").parquet(folder)
    assert run().count() == len(want)


def test_bounded_dedup_stream(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    events = land(spark, folder, 2)
    events.write.mode("append").parquet(folder)
    s = streams.file_stream(spark, folder, events.schema).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    q = (streams.bounded_dedup(s, "event_id", "ts", "1 day").writeStream.format("parquet")
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(out))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == events.count()


def test_trend_stream_equals_batch(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    events = land(spark, folder)

    def log(df):
        return df.select(F.col("ts").cast("timestamp").alias("ts"),
                         F.col("event_type").alias("label"), F.col("value").alias("confidence"))
    s = streams.file_stream(spark, folder, events.schema, max_files=1)
    streams.replace_table(streams.confidence_trend(log(s), delay="1 hour"), out,
                          f"{tmp_path}/ck").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {tuple(r) for r in streams.confidence_trend(log(events)).collect()}


def test_score_stream_appends_to_the_log(spark, tmp_path):
    vectors = views.table(spark, SF_DIR, "embeddings")
    vectors.repartition(3).write.parquet(f"{tmp_path}/in")

    def to_log(df):
        rows = df.select("vec_id", F.slice("embedding", 1, 5).alias("e"))
        return scoring.log_entries(scoring.decode_logits(rows, "e", LABELS), "batch", F.lit("u"))
    s = streams.file_stream(spark, f"{tmp_path}/in", vectors.schema, max_files=1)
    streams.score_and_append(s, f"{tmp_path}/log", f"{tmp_path}/ck", to_log).awaitTermination()
    assert readers.read_log(spark, f"{tmp_path}/log").count() == vectors.count()


def test_replayed_batches_replace_their_rows(spark, tmp_path):
    """A stream that starts again without its checkpoint gives batch 0, 1, ... once more."""
    vectors = views.table(spark, SF_DIR, "embeddings")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/in")

    def to_log(df):
        rows = df.select("vec_id", F.slice("embedding", 1, 5).alias("e"))
        ts = F.timestamp_seconds(F.col("vec_id") * 86_400)
        return scoring.log_entries(scoring.decode_logits(rows, "e", LABELS), "batch", F.lit("u"), ts)
    for run in range(2):
        s = streams.file_stream(spark, f"{tmp_path}/in", vectors.schema)
        streams.score_and_append(s, f"{tmp_path}/log", f"{tmp_path}/ck{run}", to_log).awaitTermination()
    assert readers.read_log(spark, f"{tmp_path}/log").count() == vectors.count()


def test_upserted_trend_keeps_the_newest_row(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ts timestamp, label string, confidence double"
    for hours in ((0, 0, 1), (1, 2), (2, 3)):
        rows = [(h, "bug", 50.0 + h) for h in hours]
        spark.createDataFrame(rows, "h int, label string, confidence double").select(
            F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "label", "confidence").coalesce(
            1).write.mode("append").parquet(folder)
    s = streams.file_stream(spark, folder, schema, "*.parquet", max_files=1)
    streams.upsert_table(streams.confidence_trend(s, delay="1 hour"), out, f"{tmp_path}/ck").awaitTermination()
    got = {r["window_start"].hour: r["n"] for r in streams.latest(spark, out, ["window_start", "label"]).collect()}
    assert list(got.values()) == [got[h] for h in got] and sorted(got.values()) == [1, 2, 2, 2]
    state = spark.read.parquet(out)
    assert state.count() < 4 * state.select("batch").distinct().count()  # only changed hours are stored


def test_streams_read_tables_of_one_file_and_of_part_files(spark, tmp_path):
    vectors = spark.range(40).selectExpr("id AS vec_id", "cast(id % 10 AS int) AS label",
                                         "array_repeat(cast(id AS float) / 40, 64) AS embedding")
    vectors.repartition(3).write.parquet(f"{tmp_path}/parts/embeddings.parquet")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/whole")
    (one,) = (tmp_path / "whole").glob("part-*")
    (tmp_path / "file").mkdir()
    one.rename(tmp_path / "file/embeddings.parquet")
    got = [sorted(map(tuple, QUERIES["T02_score_stream"](spark, f"{tmp_path}/{d}").collect()))
           for d in ("parts", "file")]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == 40
