"""Dedup, per-group top-k, quotas and ordering, safe for very large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamsift.functions.text import digest
from loamsift.session import stash
from loamsift.sources.positions import PLACE, choose, file_backed, located

# Sub-groups a large group is ranked in first.
SPREAD = 1024


def first_per_key(df: DataFrame, keys: Sequence[Column | str],
                  order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of every key.

    ``row_number() = 1`` lets Spark keep one row per key inside each map task
    before the shuffle, so a key with a third of all rows costs one row per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_texts(df: DataFrame, texts: Sequence[str], also: Sequence[str] = (),
                order: str = "row_id") -> DataFrame:
    """Exact dedup on text columns by 256-bit digests; only narrow rows are ranked.

    ``order`` is a unique id. The first rows are picked by their places in the source's files,
    so texts are not shuffled.
    """
    df = file_backed(df)
    keys = located(df).select(order, *PLACE, *also, *[digest(t).alias(f"_{t}") for t in texts])
    return choose(df, first_per_key(keys, [*also, *[f"_{t}" for t in texts]], [order]))


def dedup_title_body(df: DataFrame) -> DataFrame:
    """First row of each (title, body), across labels."""
    return dedup_texts(df, ["title", "body"])


def dedup_title_then_body(df: DataFrame) -> DataFrame:
    """First of (title, label), then, among those, first of (body, label)."""
    df = file_backed(df)
    keys = located(df).select("row_id", *PLACE, "label", digest("title").alias("_t"),
                              digest("body").alias("_b"))
    first = first_per_key(first_per_key(keys, ["label", "_t"], ["row_id"]), ["label", "_b"],
                          ["row_id"])
    return choose(df, first)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                  spread: int = SPREAD, row_limit: Column | None = None) -> DataFrame:
    """First ``k`` rows per group in ``order`` (which must be total).

    A group is ranked in ``spread`` parts first, so that a group with a third of
    all rows is never sorted by one task; at most ``spread * k`` rows per group
    reach the second ranking. The part is the scan partition, so for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` each map task also cuts its
    own share before the shuffle. Any split into parts gives the same rows.
    ``row_limit`` is a tighter limit per row (<= k), applied to the final rank.
    """
    parts = df.withColumn("_part", F.spark_partition_id() % spread)
    local = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    trimmed = parts.withColumn("_rn", local).where(F.col("_rn") <= k).drop("_rn", "_part")
    final = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ranked = trimmed.withColumn("_rn", final).where(F.col("_rn") <= k)
    if row_limit is not None:
        ranked = ranked.where(F.col("_rn") <= row_limit)
    return ranked.drop("_rn")


def cap_per_label(df: DataFrame, cap: int, labels: Sequence[str], size: Column,
                  id_col: str = "row_id") -> DataFrame:
    """Per label, the ``cap`` rows of largest ``size``; ties go to the lower id.

    Only (label, size, id, place) is ranked; the wide rows are never shuffled.
    """
    df = file_backed(df)
    narrow = located(df).where(F.col("label").isin(*labels)).select(
        id_col, "label", size.alias("_size"), *PLACE)
    return choose(df, top_per_group(narrow, ["label"], [F.desc("_size"), id_col], cap))


def within_quota(counts: DataFrame, target: int, have: DataFrame | None = None) -> DataFrame:
    """(label, repo) pairs taken whole while the total before them is below target.

    ``counts`` has one row per (label, repo, stars) with ``n`` rows behind it, so it
    is bounded by labels x selected repos. The last repo taken may overshoot.
    """
    before = W.partitionBy("label").orderBy(F.desc("stars"), "repo").rowsBetween(
        W.unboundedPreceding, -1)
    df = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if have is not None:
        df = df.join(have.select("label", "have"), "label", "left")
    else:
        df = df.withColumn("have", F.lit(0))
    return df.where(F.col("_before") + F.coalesce("have", F.lit(0)) < target).select(
        "label", "repo")


def shuffled(df: DataFrame, seed: int, id_col: str = "row_id") -> DataFrame:
    """Reproducible shuffle: global order by a seeded hash of the row id."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def dense_index(df: DataFrame, id_col: str = "row_id", out: str = "index") -> DataFrame:
    """0-based dense index in id order without sorting everything in one task.

    Rows are range-partitioned by id and stored; a partition's offset is the row count of
    those before it (one number a partition), and rows are numbered inside theirs. The
    number of partitions is that of the session's shuffles, so it grows with the cluster.
    """
    placed = stash(df.repartitionByRange(id_col).withColumn("_part", F.spark_partition_id()),
                   "ranges")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(id_col)) - 1
    return (placed.withColumn("_inside", inside).join(offsets, "_part")
            .withColumn(out, F.col("_offset") + F.col("_inside"))
            .drop("_part", "_inside", "_offset"))
