"""The training-data pipeline: five stages over ``documents``, each by one operator of llm.

Every stage is written as Parquet into the shared scratch folder and read again as the next
stage's ``docs``. The first four return the columns of documents; the last returns pieces.

Defined cases: null texts pass quality as an empty passage scores, keep their null in line
dedup, are linked with nothing and are packed as one end id; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm import contain, lines, neardup, packing, quality
from loamsift.llm.common import held_out, table
from loamsift.session import stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

QUALITY = 0.5  # documents with a lower chance of label 1 go
LINE_DOCUMENTS = 10  # a line found in so many documents goes everywhere
WORDS, PERCENT = 5, 80  # shingle size and Jaccard similarity of near copies
CONTAINED = 0.8  # share of an item's shingles found in a document
TOKENS, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                        ~held_out(4, 2))
    return quality.keep_good(docs, model, QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_lines(docs, min_docs=LINE_DOCUMENTS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, WORDS, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contain.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), WORDS, CONTAINED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER), END_ID, TOKENS)
    return packing.pack(cut, TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", keep_one_copy),
    ("decontamination", decontaminate), ("packing", pack),
]

# a learned classifier and a tokenizer have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
