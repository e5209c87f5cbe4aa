"""Aggregations: counts, shares, word statistics, audits, balance, log analytics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions.scores import mean1, round1, share_bar
from loamsift.functions.text import word_count


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def class_shares(df: DataFrame, key: str = "label") -> DataFrame:
    """n, percent and bar per class; the total is taken over the few counted rows."""
    pct = F.col("n") / F.sum("n").over(W.partitionBy()) * 100
    return count_by(df, key).withColumn("_pct", pct).select(
        key, "n", round1(F.col("_pct")).alias("pct"), share_bar(F.col("_pct")).alias("bar"))


def top_counts(df: DataFrame, key: str = "repo", n: int = fixed.TOP_REPORT_ROWS) -> DataFrame:
    return count_by(df, key).orderBy(F.desc("n"), key).limit(n)


def mean_confidence(df: DataFrame, *keys: str) -> DataFrame:
    agg = mean1("confidence").alias("avg_confidence")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def source_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"),
                   F.count_if(F.col("source") == "single").alias("single_count"),
                   F.count_if(F.col("source") == "batch").alias("batch_count"))


def word_stats(df: DataFrame, *columns: str) -> DataFrame:
    """Mean, median, min and max words per column, one row each.

    The exact median keeps one counter per distinct length, and lengths are few.
    """
    counts = df.select(*[word_count(c).cast("long").alias(c) for c in columns])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("words")) for c in columns]))
    return (counts.select(pairs.alias("p")).groupBy(F.col("p.column").alias("column")).agg(
        F.avg("p.words").alias("mean_words"), F.median("p.words").alias("median_words"),
        F.min("p.words").alias("min_words"), F.max("p.words").alias("max_words")))


def balance_ratio(df: DataFrame) -> DataFrame:
    """Largest class over smallest class, NULL for no rows."""
    return count_by(df, "label").agg(
        (F.max("n") / F.nullif(F.min("n"), F.lit(0))).alias("balance_ratio"))


def cell_audit(df: DataFrame) -> DataFrame:
    """NULL cells and empty-text cells over all columns, in one pass."""
    def total(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.count_if(t) for t in tests], F.lit(0))
    text = [c for c, t in df.dtypes if t == "string"]
    return df.agg(total([F.col(c).isNull() for c in df.columns]).alias("nulls"),
                  total([F.col(c) == "" for c in text]).alias("empties"))


def placeholder_leak(df: DataFrame, column: str = "body") -> DataFrame:
    found = F.regexp_count(F.col(column), F.lit(fixed.PLACEHOLDER_LEAK))
    return df.agg(F.coalesce(F.sum(found), F.lit(0)).cast("long").alias("placeholders"))


def reason_histogram(df: DataFrame) -> DataFrame:
    return count_by(df.withColumn("reason", F.coalesce("reason", F.lit("passed"))), "reason")


def shortfall(have: DataFrame, labels: DataFrame, target: int) -> DataFrame:
    """Per label: rows present and rows still needed (none below zero)."""
    return (labels.join(have.select("label", F.col("n").alias("have")), "label", "left")
            .select("label", F.coalesce("have", F.lit(0)).alias("have"))
            .withColumn("needed", F.greatest(F.lit(target) - F.col("have"), F.lit(0))))


def rare_labels(have: DataFrame, labels: DataFrame, target: int) -> DataFrame:
    return shortfall(have, labels, target).where(
        F.col("have") < F.lit(target * fixed.SHORTFALL_SHARE))


def star_range(repos: DataFrame) -> DataFrame:
    return repos.agg(F.min("stars").alias("min_stars"), F.max("stars").alias("max_stars"))


def removed_per_stage(funnel: DataFrame) -> DataFrame:
    """Rows lost at each stage of a funnel (a handful of rows)."""
    prev = F.lag("n").over(W.orderBy("stage_no"))
    return funnel.withColumn("removed", F.coalesce(prev - F.col("n"), F.lit(0)))


def class_weights(df: DataFrame) -> DataFrame:
    """n_total / (n_classes * n_label) per label."""
    everything = W.partitionBy()
    return count_by(df, "label").select(
        "label", "n",
        (F.sum("n").over(everything)
         / (F.count("*").over(everything) * F.col("n"))).alias("weight"))


def timeline(log: DataFrame, n: int = fixed.TIMELINE_ROWS,
             tie: Sequence[str] = ("label", "confidence", "source", "user")) -> DataFrame:
    """The last ``n`` log rows in time order; ``tie`` orders rows of one instant.

    A stored log gives the few days that can hold them: ``readers.read_newest``.
    """
    last = log.orderBy(F.desc("ts"), *[F.desc(c) for c in tie]).limit(n)
    return last.orderBy("ts", *tie)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion cells."""
    row = F.col("truth").alias("label")
    by_truth = cells.groupBy(row).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_pred = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_truth.join(by_pred, "label", "full").na.fill(0)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return both.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"),
                    F.col("precision") + F.col("recall"))).select(
        "label", "precision", "recall", "f1", "support", "hits")


def overall_report(cells: DataFrame) -> DataFrame:
    return class_report(cells).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
