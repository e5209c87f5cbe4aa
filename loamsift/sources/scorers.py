"""Stored scorers: a fitted pipeline, its label config and a signature that ties them together.

``save_scorer`` writes the pipeline and the config into folders of their own and the signature last,
so a scorer is there whole or not at all. ``load_scorer`` refuses a config whose names or order, or
a model whose classes, features or weights differ from the signature's. Predictions take their
names from the stored config, by its ids.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from loamsift.operators import scoring
from loamsift.sources.readers import label_names, read_label_config


class StoredScorer(NamedTuple):
    model: PipelineModel
    labels: tuple[str, ...]

    def __call__(self, df: DataFrame) -> DataFrame:
        """Score ``text``; names come from the stored config."""
        return scoring.score_with_model(df, self.model, self.labels)


def _model_facts(model: PipelineModel) -> dict:
    last = model.stages[-1]
    weights = hashlib.sha256()
    weights.update(last.coefficientMatrix.toArray().tobytes())
    weights.update(last.interceptVector.toArray().tobytes())
    return {"classes": last.numClasses, "features": last.numFeatures, "weights_sha256": weights.hexdigest(),
            "stages": [type(s).__name__ for s in model.stages]}


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _file(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    target, fs = _file(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def has_scorer(spark: SparkSession, path: str) -> bool:
    target, fs = _file(spark, f"{path}/signature.json")
    return fs.exists(target)


def config_text(labels: tuple[str, ...]) -> str:
    """The label config of ``labels``, whose ids are their places."""
    return json.dumps({"labels": {x: i for i, x in enumerate(labels)},
                       "id2label": {str(i): x for i, x in enumerate(labels)}}, indent=2)


def config_labels(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Label names by id of a config file; its two maps must agree and its ids count from 0."""
    rows = label_names(read_label_config(spark, path)).orderBy("label_id").collect()
    if [r["label_id"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError("label ids do not count from 0")
    wrong = [r["label"] for r in rows if r["declared_id"] != r["label_id"]]
    if wrong:
        raise ValueError(f"the config's two maps differ for {', '.join(wrong)}")
    return tuple(r["label"] for r in rows)


def save_scorer(model: PipelineModel, labels: tuple[str, ...], path: str, spark: SparkSession) -> None:
    """Store a fitted pipeline with its labels; an earlier scorer at ``path`` is replaced."""
    facts = _model_facts(model)
    if facts["classes"] != len(labels):
        raise ValueError(f"the model has {facts['classes']} classes for {len(labels)} labels")
    own = uuid.uuid4().hex
    model.save(f"{path}/model-{own}")
    _write_text(spark, f"{path}/labels-{own}.json", config_text(labels))
    _write_text(spark, f"{path}/signature.json", json.dumps(
        {"folder": own, "labels": list(labels), **facts}))


def load_scorer(spark: SparkSession, path: str, config: str | None = None) -> StoredScorer:
    """The scorer at ``path``; ``config`` is a label config that it must fit, else its own."""
    signature = json.loads(_read_text(spark, f"{path}/signature.json"))
    own = signature["folder"]
    labels = config_labels(spark, config or f"{path}/labels-{own}.json")
    if list(labels) != signature["labels"]:
        raise ValueError(f"labels {', '.join(labels)} are not those of the scorer: "
                         f"{', '.join(signature['labels'])}")
    model = PipelineModel.load(f"{path}/model-{own}")
    facts = _model_facts(model)
    differing = [k for k, v in facts.items() if signature[k] != v]
    if differing:
        raise ValueError(f"the stored model does not fit its signature: {', '.join(differing)}")
    return StoredScorer(model, labels)
