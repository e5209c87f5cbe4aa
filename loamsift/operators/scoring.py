"""Batch scoring with a pluggable model, decoding, training and evaluation."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamsift import fixed
from loamsift.functions import scores
from loamsift.functions.text import strip
from loamsift.operators.gates import guard_record
from loamsift.operators.summary import class_weights
from loamsift.session import stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no import path

# A scorer maps a batch of model inputs to logits, one row per input.
Scorer = Callable[[pd.Series], np.ndarray]


def pair_text(title: str = "title", body: str = "body") -> Column:
    """Stripped title, and the stripped body only when there is one."""
    return F.concat_ws(" ", F.coalesce(strip(title), F.lit("")),
                       F.nullif(strip(body), F.lit("")))


def with_logits(df: DataFrame, model_input: Column, load: Callable[[], Scorer],
                n_labels: int, budget: int | None = None,
                tokens: Callable[[pd.Series], np.ndarray] | None = None) -> DataFrame:
    """Add ``logits`` by a Python model, loaded once per worker.

    Only the model input travels to Python, in Arrow batches; the other columns
    stay in the JVM. A model with another number of labels is refused.

    A model that pads its inputs to the longest of a batch works on what it pads too. With a
    ``budget`` the rows of an Arrow batch go to the model in order of length (``tokens``), cut so
    that rows times the longest stay within the budget (a longer row goes alone), and the logits
    return to their rows.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def scored(batch: pd.Series) -> np.ndarray:
            out = np.asarray(model(batch), dtype="float64").reshape(len(batch), -1)
            if len(batch) and out.shape[1] != n_labels:
                raise ValueError(f"model gives {out.shape[1]} scores for {n_labels} labels")
            return out
        for batch in batches:
            if budget is None:
                yield pd.Series(list(scored(batch)))
                continue
            logits = np.empty((len(batch), n_labels))
            for rows in cuts(np.asarray(tokens(batch)), budget):
                logits[rows] = scored(batch.iloc[rows])
            yield pd.Series(list(logits))
    cuts = token_batches
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, T.ArrayType(T.DoubleType()))
    return df.withColumn("logits", udf(model_input))


def token_batches(lengths: np.ndarray, budget: int, by_length: bool = True) -> list[np.ndarray]:
    """Row numbers of batches whose rows times longest length stay within ``budget``."""
    order = np.argsort(lengths, kind="stable") if by_length else np.arange(len(lengths))
    out, lo, longest = [], 0, 0
    for i, row in enumerate(order):
        longest = max(longest, int(lengths[row]))
        if i > lo and longest * (i - lo + 1) > budget:
            out.append(order[lo:i])
            lo, longest = i, int(lengths[row])
    return [*out, order[lo:]] if len(order) else out


def padded_tokens(lengths: np.ndarray, batches: list[np.ndarray]) -> int:
    """Tokens a model works on when each batch is padded to its longest row."""
    return sum(len(rows) * int(lengths[rows].max(initial=0)) for rows in batches)


def word_tokens(most: int) -> Callable[[pd.Series], np.ndarray]:
    """White-space words of a text, at least one and at most ``most``, as a token count."""
    def count(texts: pd.Series) -> np.ndarray:
        words = texts.fillna("").str.split().str.len().to_numpy()
        return np.clip(words, 1, most)
    return count


def decode(df: DataFrame, probabilities: Column, labels: tuple[str, ...]) -> DataFrame:
    """Add predicted_label, confidence, confidences and color from probabilities."""
    with_p = df.withColumn("_p", probabilities)
    best = scores.argmax(F.col("_p"))
    return (with_p
            .withColumn("predicted_label",
                        F.element_at(scores.label_array(labels), (best + 1).cast("int")))
            .withColumn("confidence", scores.round1(F.array_max("_p") * 100))
            .withColumn("confidences", scores.percent_map(F.col("_p"), labels))
            .withColumn("color", scores.label_color(F.col("predicted_label"), labels))
            .drop("_p"))


def decode_logits(df: DataFrame, logits: Column | str, labels: tuple[str, ...]) -> DataFrame:
    logits = F.col(logits) if isinstance(logits, str) else logits
    return decode(df, scores.softmax(logits), labels)


def wide_scores(scored: DataFrame, labels: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Input columns plus predicted_label, confidence_% and score_<label>."""
    return scored.select(
        *keep, "predicted_label", F.col("confidence").alias("confidence_%"),
        *[c.alias(n) for n, c in scores.score_columns(F.col("confidences"), labels).items()])


def log_entries(scored: DataFrame, source: str, user: Column, ts: Column | None = None) -> DataFrame:
    return scored.select(
        (F.current_timestamp() if ts is None else ts).alias("ts"),
        F.col("predicted_label").alias("label"), "confidence",
        F.lit(source).alias("source"), user.alias("user"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Per label: count; plus the total and mean confidence of the batch on each row."""
    per_label = scored.groupBy("predicted_label").agg(
        F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("_sum"))
    whole = Window.partitionBy()
    total = F.sum("n").over(whole)
    return per_label.select(
        "predicted_label", "n", total.alias("total"),
        scores.round1(F.sum("_sum").over(whole) / total).cast("double").alias("avg_confidence"))


TERMS = "_tf"  # hashed word counts of a text


def _word_stages(features: int) -> list:
    return [RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"\s+"),
            HashingTF(inputCol="_tokens", outputCol=TERMS, numFeatures=features)]


def count_terms(df: DataFrame, features: int = 1 << 14) -> DataFrame:
    """Add the hashed word counts of ``text``.

    Stored, they serve any number of trainings and scorings: no text is split again.
    """
    return PipelineModel(_word_stages(features)).transform(df).drop("_tokens")


def train_classifier(df: DataFrame, features: int = 1 << 14, max_iter: int = 20) -> PipelineModel:
    """Default scorer: hashed words, inverse document frequency, weighted logistic model.

    ``df`` has ``text`` and ``label``, or ``label`` and the terms that ``count_terms`` gives; label
    ids are the sorted label names. Texts are split once, into stored terms that every pass of the
    fit reads. The weights correct for class imbalance instead of repeating rows.
    """
    ids = {name: i for i, name in enumerate(fixed.LABELS_MODEL)}
    known = df.withColumn("label_id", scores.encode_label(F.col("label"), ids).cast("double")
                          ).where(F.col("label_id").isNotNull())
    if TERMS not in df.columns:
        known = stash(count_terms(known, features).select("label", "label_id", TERMS), "terms")
    weights = class_weights(known).select("label", "weight")  # one row per known label
    data = known.join(F.broadcast(weights), "label")
    idf = IDF(inputCol=TERMS, outputCol="_features").fit(data)
    if len(idf.idf) != features:
        raise ValueError(f"the terms have {len(idf.idf)} features, not {features}")
    last = LogisticRegression(featuresCol="_features", labelCol="label_id", weightCol="weight",
                              maxIter=max_iter, regParam=0.01, probabilityCol="_probability",
                              rawPredictionCol="_raw", predictionCol="_prediction").fit(idf.transform(data))
    return PipelineModel([*_word_stages(features), idf, last])


def score_with_model(df: DataFrame, model: PipelineModel,
                     labels: tuple[str, ...] = fixed.LABELS_MODEL) -> DataFrame:
    """Score ``text``, or the terms counted from it, inside the JVM and decode."""
    if model.stages[-1].numClasses != len(labels):
        raise ValueError("model and label config have different numbers of labels")
    out = (PipelineModel(model.stages[2:]) if TERMS in df.columns else model).transform(df)
    scored = decode(out, vector_to_array("_probability"), labels)
    return scored.drop("_tokens", TERMS, "_features", "_raw", "_probability", "_prediction")


def score_record(spark: SparkSession, title: str | None, body: str | None,
                 score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One record through the batch scorer."""
    guard_record(title, body)
    row = spark.createDataFrame([(title, body)], "title string, body string")
    return score(row.withColumn("text", pair_text()))
