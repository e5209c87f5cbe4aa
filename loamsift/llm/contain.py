"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are split into classes by their number of shingles. For a class of at most ``u``
shingles every document is read as windows of two neighbouring blocks of ``u`` shingles, so an
item found anywhere, also deep in a very long document, lies whole in one window of about its
own size, and its Jaccard similarity with that window is high. Windows and items are compared
by ``HASHES`` single-row MinHash tables; each candidate is verified by exact containment: the
share of the item's distinct shingles among all shingles of the document.

Items are the stated query set. They are dealt into blocks of about ``BLOCK_SHINGLES``
shingles, each searched by one pass over the documents, so what is sent to the tasks is
bounded whatever the number of items. The documents are never shuffled.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z;
items and documents without words match nothing; with fewer words than a shingle the whole
sequence is one shingle; repeated items with one id count once; every document row is judged
on its own; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.common import (ALPHANUMERIC, WordHasher, arrow_map, chunks, ranges, seeds,
                                 shingles, text_bytes)

HASHES = 48
CLASS_STEP = 1.5  # sizes of a class differ by this factor at most
BLOCK_SHINGLES = 1_000_000
_FACTORS, _SHIFTS = seeds(HASHES, 21) | np.uint64(1), seeds(HASHES, 22)


def _hashed(x: np.ndarray, f: int) -> np.ndarray:
    return ((x * _FACTORS[f] + _SHIFTS[f]) >> np.uint64(32)).astype(np.uint32)


class ItemBlock:
    """Sorted MinHash tables and exact shingle sets of one block of items."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.array([len(s) for s in sets])
        level = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(CLASS_STEP) - 1e-9).astype(int)
        self.classes = []
        for c in np.unique(level):
            members = np.flatnonzero(level == c)
            width = int(sizes[members].max())
            joined = np.concatenate([sets[i] for i in members])
            at = np.concatenate([[0], np.cumsum(sizes[members])[:-1]])
            tables = []
            for f in range(HASHES):
                low = np.minimum.reduceat(_hashed(joined, f), at)
                order = np.argsort(low, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[low >> 16] = True
                tables.append((low[order], members[order], seen))
            self.classes.append((width, tables))

    @classmethod
    def of(cls, state: dict) -> ItemBlock:
        """The block with the state ``vars`` gave: plain arrays travel without an import path."""
        block = cls.__new__(cls)
        block.__dict__.update(state)
        return block

    def search(self, words: np.ndarray, first: np.ndarray, threshold: float
               ) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) over the threshold, of documents' shingles."""
        counts = np.diff(first)
        pairs = set()
        blocks = []
        for width, tables in self.classes:
            n = -(-counts // width)
            at = np.repeat(first[:-1], n) + ranges(np.zeros(len(n), int), n) * width
            doc = np.repeat(np.arange(len(n)), n)
            blocks.append((at, doc, np.concatenate([doc[1:] == doc[:-1], [False]]), tables))
        if not len(words):
            return
        for f in range(HASHES):
            values = _hashed(words, f)
            for at, doc, more, tables in blocks:
                low, owner, seen = tables[f]
                if not len(at):
                    continue
                window = np.minimum.reduceat(values, at)
                window[:-1] = np.where(more[:-1], np.minimum(window[:-1], window[1:]), window[:-1])
                hit = np.flatnonzero(seen[window >> 16])
                if not len(hit):
                    continue
                lo = np.searchsorted(low, window[hit], "left")
                hi = np.searchsorted(low, window[hit], "right")
                docs = np.repeat(doc[hit], hi - lo)
                pairs.update(zip(docs.tolist(), owner[ranges(lo, hi - lo)].tolist()))
        sets = {d: np.unique(words[first[d]:first[d + 1]]) for d in {d for d, _ in pairs}}
        for d, i in sorted(pairs):
            shared = int(np.isin(self.sets[i], sets[d], assume_unique=True).sum())
            if shared >= threshold * len(self.sets[i]) - 1e-9:
                yield d, i, shared


def item_blocks(items: DataFrame, k: int) -> Iterator[tuple[list, ItemBlock]]:
    """Item ids and tables of each block; a block holds about BLOCK_SHINGLES shingles."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = WordHasher(ALPHANUMERIC)
        for b in batches:
            s, first = shingles(*hasher(text_bytes(b["text"])), k)
            sets = [np.unique(s[x:y]) for x, y in zip(first[:-1], first[1:])]
            yield {"item_id": b["item_id"], "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = [np.unique(np.frombuffer(b"".join(x), np.uint64)) for x in b["parts"].to_pylist()]
            yield {"item_id": b["item_id"], "n": [len(x) for x in sets],
                   "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}
    # the texts of one item_id are one item
    parts = arrow_map(items.select("item_id", "text").distinct(), run, f"item_id {kind}, shingles binary")
    parts = parts.groupBy("item_id").agg(F.collect_list("shingles").alias("parts"))
    table = arrow_map(parts, united, f"item_id {kind}, n int, shingles binary").where("n > 0")
    total = table.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // BLOCK_SHINGLES)
    for block in range(n_blocks):
        rows = table.where(F.pmod(F.xxhash64("shingles"), F.lit(n_blocks)) == block).collect()
        if rows:
            yield [r["item_id"] for r in rows], ItemBlock(
                [np.frombuffer(r["shingles"], np.uint64) for r in rows])


def _search(texts: list[bytes], hasher: WordHasher, block: ItemBlock, k: int,
            threshold: float) -> Iterator[tuple[int, int, int]]:
    for lo, hi in chunks(texts):
        for d, i, shared in block.search(*shingles(*hasher(texts[lo:hi]), k), threshold):
            yield lo + d, i, shared


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    spark = docs.sparkSession
    d_kind = docs.schema["doc_id"].dataType.simpleString()
    i_kind = items.schema["item_id"].dataType.simpleString()
    schema = (f"doc_id {d_kind}, item_id {i_kind}, n_shared long, n_item long, "
              "containment double")
    found = spark.createDataFrame([], schema)
    for ids, tables in item_blocks(items, k):
        shared_block = spark.sparkContext.broadcast(vars(tables))
        id_array = pa.array(ids)

        def run(batches: Iterator[pa.RecordBatch], sent=shared_block, id_array=id_array):
            hasher, block = WordHasher(ALPHANUMERIC), ItemBlock.of(sent.value)
            for b in batches:
                out = list(_search(text_bytes(b["text"]), hasher, block, k, threshold))
                sizes = [len(block.sets[x[1]]) for x in out]
                yield {"doc_id": b["doc_id"].take(pa.array([x[0] for x in out], pa.int64())),
                       "item_id": id_array.take(pa.array([x[1] for x in out], pa.int64())),
                       "n_shared": [x[2] for x in out], "n_item": sizes,
                       "containment": [x[2] / n for x, n in zip(out, sizes, strict=True)]}
        found = found.unionByName(arrow_map(docs.select("doc_id", "text"), run, schema))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5,
                      threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item; all columns stay, nothing is shuffled."""
    for _, tables in item_blocks(items, k):
        sent = docs.sparkSession.sparkContext.broadcast(vars(tables))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hasher, block = WordHasher(ALPHANUMERIC), ItemBlock.of(sent.value)
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[x[0] for x in _search(text_bytes(b["text"]), hasher, block, k,
                                            threshold)]] = False
                yield b.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
