"""Sinks: CSV, JSON, report text, state, scored batches and the score log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.session import stash
from loamsift.sources.committed import CommittedTable, Part

CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows (section, line, metric, value) as aligned text, in order.

    A report has one row per stage, label and figure, so one file is enough. Longer
    entries are written whole and only lose the alignment.
    """
    def padded(name: str, width: int, left: bool = False):
        fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(name)))
        return F.concat(fill, F.col(name)) if left else F.concat(F.col(name), fill)
    text = F.concat(padded("section", 14), F.lit(" "), padded("metric", 34), F.lit(" "),
                    padded("value", 14, left=True))
    (report.orderBy("section", "line").select(text.alias("value")).coalesce(1)
     .write.mode("overwrite").text(path))


def save_state(path: str, seen: DataFrame, done: DataFrame, token: str | None = None) -> bool:
    """Add newly seen ids and finished (label, repo) pairs, both or neither.

    A repeated call with the ``token`` of an earlier one adds nothing and returns False.
    """
    return CommittedTable(seen.sparkSession, path).commit(
        token or uuid.uuid4().hex, seen=seen.select(F.col("id").cast("long").alias("id")),
        done=done.select("label", "repo").distinct())


def write_batch(scored: DataFrame, path: str, batch_id: str) -> None:
    """One folder per batch; writing a batch again replaces only that batch."""
    (scored.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def append_log(entries: DataFrame, path: str, token: str | None = None, replace: bool = False) -> bool:
    """Add score-log rows, one folder per day, and their sums by label and source, as one commit.

    A repeated call with the ``token`` of an earlier one adds nothing and returns False; with
    ``replace`` its rows take the place of the earlier ones.
    """
    rows = stash(entries.select("ts", "label", "confidence", "source", "user"), "log_rows")
    sums = rows.groupBy("label", "source").agg(
        F.count("*").alias("n"), F.count("confidence").alias("summed"),
        F.sum(F.col("confidence").cast("decimal(18,6)")).cast("decimal(38,6)").alias("total"))
    return CommittedTable(entries.sparkSession, path).commit(
        token or uuid.uuid4().hex, replace, log=Part(rows.withColumn("day", F.to_date("ts")), "day"),
        sums=sums.coalesce(1))  # a row for each label and source
