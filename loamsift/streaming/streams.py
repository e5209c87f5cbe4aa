"""Structured Streaming: intake with first-wins ids, scoring, running analytics, trend."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamsift.functions.scores import mean1
from loamsift.operators.ranking import first_per_key
from loamsift.sources.committed import CommittedTable
from loamsift.sources.seen import SeenStore
from loamsift.sources.writers import append_log


def file_stream(spark: SparkSession, folder: str, schema, names: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files as they land in ``folder``; ``names`` is an optional file pattern."""
    reader = spark.readStream.schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of a Parquet table that is one file or a folder of part files."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    # as a pattern: a plain path of a stream must be a folder
    return file_stream(spark, f"{folder}/{{{name}}}", schema)


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
         mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each).start())


def bounded_dedup(stream: DataFrame, id_col: str, ts_col: str, delay: str) -> DataFrame:
    """First row per id within the watermark delay; state stays bounded."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def exact_intake(stream: DataFrame, out: str, checkpoint: str, id_col: str,
                 order: Sequence[str], buckets: int = 256,
                 opened: list | None = None) -> StreamingQuery:
    """First row per id over the whole history, into a ``SeenStore`` at ``out``.

    A micro-batch is one commit of rows, ids and their filter, so a replayed batch adds
    nothing. Of earlier ids only the folders that may hold one of the batch's are read;
    ``opened`` collects them.
    """
    id_type = stream.schema[id_col].dataType.simpleString()

    def each(df: DataFrame, batch: int) -> None:
        store = SeenStore(df.sparkSession, out, id_col, id_type, buckets)
        read = store.add(df, order, f"{checkpoint}-{batch}")
        if opened is not None:
            opened.append(read)
    return _run(stream, checkpoint, each)


def intake_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """What ``exact_intake`` has kept so far; ``schema`` is the stream's."""
    return CommittedTable(spark, out).read("rows", schema)


def score_stream(stream: DataFrame, out: str, checkpoint: str,
                 to_log: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Score rows as they land; ``to_log`` turns a batch into score-log rows."""
    def each(df: DataFrame, batch: int) -> None:
        to_log(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return _run(stream, checkpoint, each)


def score_and_append(stream: DataFrame, log: str, checkpoint: str,
                     to_log: Callable[[DataFrame], DataFrame], name: str = "scores") -> StreamingQuery:
    """As ``score_stream``, into a committed log; a replayed batch replaces its rows.

    ``name`` tells the batches of several streams into one log apart.
    """
    def each(df: DataFrame, batch: int) -> None:
        append_log(to_log(df), log, f"{name}-{batch}", replace=True)
    return _run(stream, checkpoint, each)


def label_means(log: DataFrame) -> DataFrame:
    """Count and mean confidence per label; batch or stream."""
    return log.groupBy("label").agg(
        F.count("*").alias("n"), mean1("confidence").alias("avg_confidence"))


def confidence_trend(log: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Mean confidence per window and label; with ``delay`` the log is watermarked."""
    rows = log.withWatermark("ts", delay) if delay else log
    return rows.groupBy(F.window("ts", width), "label").agg(
        F.count("*").alias("n"), mean1("confidence").alias("avg_confidence")
    ).select(F.col("window.start").alias("window_start"), "label", "n", "avg_confidence")


def replace_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep ``out`` equal to the current result of an aggregation (complete mode)."""
    return _run(stream, checkpoint, lambda df, _: df.write.mode("overwrite").parquet(out),
                mode="complete")


def upsert_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Store the changed rows of an aggregation, one folder per batch (update mode).

    State older than the watermark is freed; ``latest`` reads the current table.
    """
    return _run(stream, checkpoint, lambda df, batch: df.write.mode("overwrite").parquet(
        f"{out}/batch={batch}"), mode="update")


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key of an upserted table."""
    return first_per_key(spark.read.parquet(out), keys, [F.desc("batch")]).drop("batch")
