"""Word statistics of a growing table from sketches: new rows are read once, old ones never again.

Every commit keeps, for each column, exact counts, sums and extremes and a KLL sketch of the word
counts. Sketches of all commits merge into one whose quantiles have a rank error of about
``2.3 / 2 ** (LOG_K / 1.12)`` at 99 % confidence (1.1 % for 2 ** 8 items a level); mean, least and
largest stay exact. ``summary.word_stats`` is the exact form over all rows and stays the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.functions.text import word_count
from loamsift.sources.committed import CommittedTable

K = 400  # items of a sketch's level
SCHEMA = "column string, n long, words long, least long, most long, sketch binary"


def _summaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), word_count(c).cast("long").alias("w"))
                                 for c in columns])).alias("p")
    rows = df.select(counts).select("p.column", F.col("p.w").alias("w"))
    return rows.groupBy("column").agg(
        F.count("w").alias("n"), F.sum("w").alias("words"), F.min("w").alias("least"), F.max("w").alias("most"),
        F.kll_sketch_agg_bigint("w", F.lit(K)).alias("sketch"))


class WordStats:
    """Statistics of all rows ever added, kept at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = CommittedTable(spark, path)

    def add(self, df: DataFrame, columns: Sequence[str], token: str) -> bool:
        """Take in new rows (a file, a day); False when ``token`` was taken in before."""
        return self.table.commit(token, stats=_summaries(df, columns).coalesce(1))  # a row a column

    def quantiles(self, *ranks: float) -> DataFrame:
        """column, n, mean_words, min_words, max_words and one ``q<rank>`` for each of ``ranks``."""
        merged = self.table.read("stats", SCHEMA).where("n > 0").groupBy("column").agg(
            F.sum("n").alias("n"), F.sum("words").alias("words"), F.min("least").alias("min_words"),
            F.max("most").alias("max_words"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
        return merged.select(
            "column", "n", (F.col("words") / F.col("n")).alias("mean_words"), "min_words", "max_words",
            *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias(f"q{r:g}") for r in ranks])

    def word_stats(self) -> DataFrame:
        """As ``summary.word_stats``, with the median from the sketches."""
        q = self.quantiles(0.5)
        return q.select("column", "mean_words", F.col("`q0.5`").cast("double").alias("median_words"),
                        "min_words", "max_words")
