"""A trend that late rows can still correct.

``streams.confidence_trend`` with a watermark drops rows that come behind it. Here every micro-batch
commits sums that can be added up, (window, label, n, total), so there is no state to lose: rows on
time go to ``sums``; rows whose window had closed, by the largest time of the batches before and
the delay, go to ``late`` as they are and to ``corrections`` as sums. ``trend`` is what a reader saw
without them, ``corrected`` equals the trend over all rows, ``late_rows`` is the side output.

A batch is one commit, so a replayed batch adds nothing. Rows without a time have no window and are
counted nowhere, as in the batch form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamsift.functions.scores import round1
from loamsift.sources.committed import CommittedTable

ROWS = "ts timestamp, label string, confidence double"
SUMS = "window_start timestamp, label string, n long, summed long, total decimal(38,6)"
MARKS = "newest timestamp"


def _micros(interval: str) -> Column:
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")


def _start(width: str) -> Column:
    """Microseconds at which the row's window began; windows count from the epoch."""
    return F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), _micros(width))


def _sums(rows: DataFrame, width: str) -> DataFrame:
    return rows.groupBy(F.timestamp_micros(_start(width)).alias("window_start"), "label").agg(
        F.count("*").alias("n"), F.count("confidence").alias("summed"),
        F.sum(F.col("confidence").cast("decimal(18,6)")).cast("decimal(38,6)").alias("total"))


def intake(stream: DataFrame, out: str, checkpoint: str, width: str = "1 hour",
           delay: str = "1 hour") -> StreamingQuery:
    """Run over all rows that wait; ``stream`` has ts, label and confidence."""
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        table = CommittedTable(spark, out)
        rows = df.select("ts", "label", "confidence").where("ts IS NOT NULL")
        newest = table.read("marks", MARKS).agg(F.max(F.unix_micros("newest")).alias("m")).first()["m"]
        # the window ended at or before the watermark
        late = F.lit(False) if newest is None else (
            _start(width) + _micros(width) <= F.lit(newest) - _micros(delay))
        on_time, behind = rows.where(~late), rows.where(late)
        table.commit(f"{checkpoint}-{batch}", sums=_sums(on_time, width), late=behind,
                     corrections=_sums(behind, width),
                     marks=rows.agg(F.max("ts").alias("newest")).where("newest IS NOT NULL"))
    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(each).start())


def _added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start", "label").agg(
        F.sum("n").alias("n"), round1(F.sum("total") / F.sum("summed")).cast("double").alias("avg_confidence"))


def trend(spark: SparkSession, out: str) -> DataFrame:
    """window_start, label, n, avg_confidence of the rows on time."""
    return _added_up(CommittedTable(spark, out).read("sums", SUMS))


def corrected(spark: SparkSession, out: str) -> DataFrame:
    """The trend of all rows, late ones included."""
    table = CommittedTable(spark, out)
    return _added_up(table.read("sums", SUMS).unionByName(table.read("corrections", SUMS)))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    return CommittedTable(spark, out).read("late", ROWS)
