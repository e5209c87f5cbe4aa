"""Evaluation on rows a model has not seen: folds by hash, stored predictions, one report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.operators import summary
from loamsift.session import scratch_path


def fold_of(id_col: str, folds: int) -> Column:
    """The fold of a row: a hash of its id, so it stays when rows are added."""
    return F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int")


def cross_predictions(df: DataFrame, folds: int, train: Callable[[DataFrame], object],
                      score: Callable[[DataFrame, object], DataFrame], id_col: str = "row_id",
                      path: str | None = None, inputs: Sequence[str] = ("text", "label")) -> DataFrame:
    """(id, fold, label, predicted_label, confidence): every row by a model without its fold.

    Rows have ``label`` and what ``train`` takes, ``inputs``: every fold reads them anew, so stored
    terms (``scoring.count_terms``) save the work on texts. The predictions are stored, by fold, so reports drawn from
    them agree and a lost fold can be made again alone.
    """
    path = path or scratch_path(df.sparkSession, "predictions")
    held = df.withColumn("fold", fold_of(id_col, folds))
    for f in range(folds):
        model = train(held.where(F.col("fold") != f).select(*inputs))
        part = score(held.where(F.col("fold") == f), model)
        part.select(id_col, "label", "predicted_label", "confidence").write.mode("overwrite").parquet(
            f"{path}/fold={f}")
    return df.sparkSession.read.parquet(path)


def evaluate(predictions: DataFrame) -> DataFrame:
    """Per class precision, recall, F1, support and hits, with the whole's accuracy, macro F1 and
    ``majority``, the accuracy of always naming the largest class.

    Only classes that occur among the true labels count.
    """
    cells = summary.confusion(predictions, "label", "predicted_label")
    report = summary.class_report(cells).where("support > 0")
    whole = Window.partitionBy()  # one row a class
    return report.withColumns({
        "accuracy": F.sum("hits").over(whole) / F.sum("support").over(whole), "macro_f1": F.avg("f1").over(whole),
        "majority": F.max("support").over(whole) / F.sum("support").over(whole)})
