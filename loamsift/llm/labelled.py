"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_rows(docs: DataFrame, labels: DataFrame, label: str, for_training: Column,
                  per_class: int) -> DataFrame:
    """(doc_id, text, y, weight): up to ``per_class`` labelled documents of each class.

    Rows are taken in the order of a hash of doc_id. ``weight`` is the number of labelled
    training rows that a row stands for, so class shares stay those of all labels. Labels
    other than 0 and 1 take no part. Only this sample is bounded; scoring covers every row.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & for_training)
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = None
    for y, n in sorted(totals.items()):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
            per_class).withColumn("weight", F.lit(n / min(n, per_class)))
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        sample = known.withColumn("weight", F.lit(1.0))
    # at most 2 * per_class narrow rows
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


class Adam:
    """Adam steps for a dict of numpy arrays."""

    def __init__(self, rate: float):
        self.rate, self.step, self.mean, self.square = rate, 0, {}, {}

    def __call__(self, params: dict, grads: dict) -> None:
        self.step += 1
        for name, g in grads.items():
            m = self.mean[name] = 0.9 * self.mean.get(name, 0) + 0.1 * g
            v = self.square[name] = 0.999 * self.square.get(name, 0) + 0.001 * g * g
            scale = self.rate * (1 - 0.999 ** self.step) ** 0.5 / (1 - 0.9 ** self.step)
            params[name] -= scale * m / (v ** 0.5 + 1e-8)
