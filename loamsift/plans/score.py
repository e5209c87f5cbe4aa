"""Batch scoring of an upload and the analytics over the score log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions.scores import mean1, round1
from loamsift.operators import gates, scoring, summary
from loamsift.sources import readers


def prepare_upload(upload: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Valid rows with the model input in ``text``."""
    rows = gates.guard_batch(gates.valid_upload_rows(upload), max_rows)
    return rows.withColumn("text", scoring.pair_text())


def score_upload(upload: DataFrame, score: Callable[[DataFrame], DataFrame],
                 labels: tuple[str, ...] = fixed.LABELS_MODEL,
                 max_rows: int | None = None) -> DataFrame:
    """Wide scored table with every column of the upload."""
    scored = score(prepare_upload(upload, max_rows))
    return scoring.wide_scores(scored, labels, upload.columns)


def analytics(log: DataFrame, newest: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result tables of the log view; all empty or zero for an empty log.

    ``newest`` are the log's last days (``readers.read_newest``), so that the timeline does not
    scan the whole log.
    """
    return {
        "labels": log.groupBy("label").agg(
            F.count("*").alias("n"),
            mean1("confidence").alias("avg_confidence")),
        "sources": summary.source_counts(log),
        "timeline": summary.timeline(log if newest is None else newest),
    }


def analytics_of_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables of a committed log without scanning it: sums of commits and newest days."""
    sums = readers.read_log_sums(spark, path)
    mean = round1(F.sum("total") / F.sum("summed")).cast("double")

    def of(source: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("source") == source, F.col("n"))), F.lit(0))
    return {
        "labels": sums.groupBy("label").agg(F.sum("n").alias("n"), mean.alias("avg_confidence")),
        "sources": sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                            of("single").alias("single_count"), of("batch").alias("batch_count")),
        "timeline": summary.timeline(readers.read_newest(spark, path, fixed.TIMELINE_ROWS)),
    }
