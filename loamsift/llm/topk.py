"""Exact top-k inner product search, block at a time.

A vector's terms are its dimensions with sign: a positive query component looks at the largest
value of a dimension, a negative one at the smallest. Vectors are ordered by a code of signs of
fixed random projections and cut into ranges (blocks) with the extremes of every term and a
forward index, the integer matrix of the block. For a query the summed term maxima of a block
bound every score in it; a task visits its blocks in the order of these bounds, scores whole
blocks through the forward index, and stops for a query once the next bound is below its k-th
score. Results of all tasks are merged exactly.

The queries are the stated set. They are sent in portions of ``QUERIES`` vectors, each searched
by one pass over all blocks, so what is sent is bounded whatever their number.

Defined cases: vectors that are null, empty of a value, not finite, or of another length than
the query take no part; a candidate with the query's own vec_id takes no part; repeated rows
with one id count as rows; null ids take no part; ties go to the smaller id; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.llm.common import arrow_map
from loamsift.session import stash

BLOCK = 256  # vectors in a block
PART = 8_192  # vectors that one task searches, about
QUERIES = 8_192  # query vectors sent at a time
GROUP = 512  # query vectors scored together
_BITS = 12


def integer_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, whole and finite vectors only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim, _BITS))


def _coded(vectors: DataFrame, dim: int) -> DataFrame:
    """Adds ``code``, the signs of fixed projections: near vectors tend to share it."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            signs = _matrix(b["v"], dim) @ _projections(dim) > 0
            yield {"vec_id": b["vec_id"], "v": b["v"], "code": signs @ (1 << np.arange(_BITS))}
    return arrow_map(vectors, run, f"vec_id {kind}, v array<bigint>, code int")


def search_blocks(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
                  ids: np.ndarray, queries: np.ndarray, k: int, work: list | None = None
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query index, vec_id, score) of these blocks for every query.

    A block is (ids, matrix, largest, smallest). ``work`` collects (scored, all) blocks.
    """
    q = queries.astype(np.float64)
    # whole numbers in floating point: sums below 2^53 are exact, larger ones take integers
    largest = int(np.abs(queries).max(initial=0)) * queries.shape[1]
    exact = all(int(np.abs(b[1]).max()) * largest < 2 ** 53 for b in blocks)
    kind, none = (np.float64, -np.inf) if exact else (object, -(1 << 200))
    nobody = np.iinfo(np.int64).max
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    bounds = (plus @ np.stack([b[2] for b in blocks]).astype(kind).T
              + minus @ np.stack([b[3] for b in blocks]).astype(kind).T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best, names = np.full((n, k), none, kind), np.full((n, k), nobody)
    alive = np.arange(n)
    scored = 0
    for step in range(len(blocks)):
        bound = bounds[alive, order[alive, step]]
        alive = alive[bound >= best[alive, -1]]
        if not len(alive):
            break
        target = order[alive, step]
        for j in np.unique(target):
            rows = alive[target == j]
            scored += len(rows)
            own, matrix = blocks[j][0], blocks[j][1]
            s = (q[rows] if exact else queries[rows].astype(object)) @ matrix.astype(kind).T
            itself = ids[rows][:, None] == own[None, :]
            s[itself] = none
            better = s.max(axis=1) >= best[rows, -1]  # a tie may have the smaller id
            rows, s, itself = rows[better], s[better], itself[better]
            all_s = np.concatenate([best[rows], s], axis=1)
            all_n = np.concatenate([names[rows], np.where(itself, nobody, own[None, :])], axis=1)
            top = np.lexsort((all_n, -all_s), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_s, top, 1)
            names[rows] = np.take_along_axis(all_n, top, 1)
    if work is not None:
        work.append((scored, n * len(blocks)))
    at, place = np.nonzero(names < nobody)
    return at, names[at, place], best[at, place].astype(np.int64)


def _blocks_of(ids: np.ndarray, matrix: np.ndarray) -> list:
    return [(ids[i:i + BLOCK], m := matrix[i:i + BLOCK], m.max(axis=0), m.min(axis=0))
            for i in range(0, len(ids), BLOCK)]


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query vector."""
    spark = df.sparkSession
    vectors = stash(integer_vectors(df.select("vec_id", "embedding"), scale), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"query_id {kind}, vec_id {kind}, score long")
    for row in vectors.groupBy(F.size("v").alias("dim")).agg(
            F.count("*").alias("n")).orderBy("dim").collect():  # a row for each vector length
        dim = row["dim"]
        if dim == 0:
            continue
        own = vectors.where(F.size("v") == dim)
        parts = -(-row["n"] // PART)
        ordered = stash(_coded(own, dim).repartitionByRange(parts, "code", "vec_id")
                        .sortWithinPartitions("code", "vec_id"), "blocks")
        asked = own.where(is_query)
        portions = -(-asked.count() // QUERIES)
        for portion in range(portions):
            rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(portions)) == portion).toArrow()
            sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(
                rows["v"].combine_chunks(), dim)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[dict]:
                ids, queries = sent.value
                for b in batches:
                    blocks = _blocks_of(b["vec_id"].to_numpy(), _matrix(b["v"], dim))
                    for lo in range(0, len(ids) if blocks else 0, GROUP):
                        at, name, score = search_blocks(blocks, ids[lo:lo + GROUP],
                                                        queries[lo:lo + GROUP], k)
                        yield {"query_id": ids[lo + at], "vec_id": name, "score": score}
            found = found.unionByName(arrow_map(
                ordered.select("vec_id", "v"), run,
                f"query_id {kind}, vec_id {kind}, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
