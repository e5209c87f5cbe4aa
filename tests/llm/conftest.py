import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, long), (6, long), (7, "same text here now"),
            (7, "same text here now"), (None, "same text here now"), (None, None), (8, "same text here now")]
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None) for i, t in rows], DOCS)
    for name in ("key", "rep", "root", "pos", "score", "salt", "rank", "shard", "slot", "keep", "node", "n",
                 "_id", "_keep", "_hash", "_map_hash", "_text_id", "_row", "_file", "_place_file", "words", "id", "rep",
                 "doc", "content", "place", "file", "row"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
