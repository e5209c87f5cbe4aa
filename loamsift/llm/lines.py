"""Line dedup: one global order of line hashes, streamed once, gives per-document bitmaps.

Lines are reduced to (128-bit hash, document, position) and range-partitioned by hash and
document, sorted within partitions. Each task streams its part: a run of equal hashes is one
line's occurrences in document order. Runs inside a partition are decided at once; the first
and the last run may go on in a neighbour, so their rows are set aside with one count for
each part and decided by the sum. A line that a third of all rows hold is thereby spread over
many tasks. What comes back is a compressed bitmap per document, never text.

Defined cases: null text and empty text are one empty line; a document is a (doc_id, text)
pair, so an exactly repeated row counts once and a null doc_id is a value of its own; lines
whose key is shorter than ``min_chars`` are always kept; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loamsift.llm.common import SPACE, arrow_map, text_bytes, unused
from loamsift.session import stash

FOUND, EDGE, SUMMARY = 0, 1, 2


def line_keys(text: bytes) -> list[bytes]:
    """A text's lines, stripped of ASCII white space, A-Z lower-cased."""
    return [x.strip(SPACE) for x in text.lower().split(b"\n")]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line with a key of at least ``min_chars``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            row, pos, digests = [], [], []
            for i, text in enumerate(text_bytes(b["text"])):
                for p, key in enumerate(line_keys(text)):
                    if len(key) >= min_chars and (
                            len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        row.append(i)
                        pos.append(p)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield {"doc_id": b["doc_id"].take(pa.array(row, pa.int64())),
                   "text_hash": b["text_hash"].take(pa.array(row, pa.int64())),
                   "pos": pos, "h1": h[:, 0], "h2": h[:, 1]}
    return arrow_map(_identified(docs), run,
                     f"doc_id {kind}, text_hash long, pos int, h1 long, h2 long")


class _Stream:
    """Runs of equal hashes from sorted batches; all but the two outer runs are decided here."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.pending: list[pa.RecordBatch] = []
        self.inner = False  # the first run of the partition has been passed

    def _edge(self, rows: pa.Table) -> Iterator[dict]:
        n, key = len(rows), self._key(rows)
        part = np.full(n, TaskContext.get().partitionId())
        lead = np.zeros(n, np.int64)
        lead[0] = 1
        yield self._out(EDGE, rows, part, lead)
        docs = 1 + int((key[2][1:] != key[2][:-1]).sum())
        yield self._out(SUMMARY, rows.slice(0, 1), part[:1], np.array([docs]))

    @staticmethod
    def _key(rows) -> tuple[np.ndarray, ...]:
        return tuple(rows[c].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch)
                     else rows[c].to_numpy() for c in ("h1", "h2", "doc_key"))

    @staticmethod
    def _out(kind: int, rows, part, n) -> dict:
        flat = {c: rows[c].combine_chunks() if isinstance(rows, pa.Table) else rows[c]
                for c in ("h1", "h2", "doc_id", "text_hash", "pos")}
        return {"kind": np.full(len(rows), kind, np.int8), **flat, "part": part, "n": n}

    def _decide(self, rows: pa.Table) -> Iterator[dict]:
        h1, h2, doc = self._key(rows)
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        fresh = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        run = np.cumsum(new) - 1
        drop = np.bincount(run[fresh])[run] >= self.min_docs
        if self.keep_first:
            drop &= ~new
        found = rows.filter(pa.array(drop))
        yield self._out(FOUND, found, np.zeros(len(found), int), np.ones(len(found), int))

    def _flush(self, last: bool) -> Iterator[dict]:
        """What is pending is whole runs; ``last``: the partition ends here."""
        if not self.pending:
            return
        rows = pa.Table.from_batches(self.pending)
        self.pending = []
        h1, h2, _ = self._key(rows)
        starts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        lo, hi = 0, len(rows)
        if not self.inner:
            lo = int(starts[0]) if len(starts) else hi
            yield from self._edge(rows.slice(0, lo))
            self.inner = True
        if last and lo < hi:
            hi = int(starts[-1]) if len(starts) else lo
            yield from self._edge(rows.slice(hi))
        if lo < hi:
            yield from self._decide(rows.slice(lo, hi - lo))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if not len(b):
                continue
            h1, h2, _ = self._key(b)
            starts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            cut = int(starts[-1]) if len(starts) else 0
            if self.pending and not cut:
                p1, p2, _ = self._key(self.pending[-1].slice(len(self.pending[-1]) - 1))
                if (p1[0], p2[0]) != (h1[0], h2[0]):
                    yield from self._flush(False)
            elif cut:
                self.pending.append(b.slice(0, cut))
                yield from self._flush(False)
            self.pending.append(b.slice(cut))
        yield from self._flush(True)


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                  keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, pos) of each line whose key is found in ``min_docs`` documents.

    ``keep_first`` spares the first occurrence, by doc_id and position.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = stash(line_rows(docs, min_chars), "lines")
    ordered = lines.withColumn("doc_key", F.xxhash64("doc_id", "text_hash"))
    by = ["h1", "h2", "doc_id", "doc_key"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return _Stream(min_docs, keep_first)(batches)
    judged = stash(arrow_map(ordered, run, f"kind byte, h1 long, h2 long, doc_id {kind}, "
                             "text_hash long, pos int, part int, n long"), "lines-judged")
    # at most two rows for each partition of the sort: a bounded table
    totals = judged.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(
        F.sum("n").alias("docs"), F.min("part").alias("first_part")
    ).where(F.col("docs") >= min_docs)
    edges = judged.where(F.col("kind") == EDGE).join(F.broadcast(totals), ["h1", "h2"])
    if keep_first:
        edges = edges.where(~((F.col("part") == F.col("first_part")) & (F.col("n") == 1)))
    cols = ["doc_id", "text_hash", "pos"]
    return judged.where(F.col("kind") == FOUND).select(*cols).unionByName(edges.select(*cols))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, text_hash, keep): a deflated bitmap, one bit a line; lines past its end stay."""
    kind = dropped.schema["doc_id"].dataType.simpleString()
    grouped = dropped.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            maps = []
            for at in b["at"]:
                at = at.values.to_numpy()
                bits = np.ones(-(-(at.max() + 1) // 8) * 8, np.uint8)  # whole bytes, padded with ones
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield {"doc_id": b["doc_id"], "text_hash": b["text_hash"],
                   "keep": pa.array(maps, pa.binary())}
    return arrow_map(grouped, run, f"doc_id {kind}, text_hash long, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """Kept text, number of lines, number dropped."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
    gone = set(np.flatnonzero(bits == 0).tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _with_bitmaps(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool
                  ) -> tuple[DataFrame, str]:
    """``docs`` with a further column of bitmaps, and its name; all columns stay."""
    of, map_hash, keep, own_hash = unused(docs, "_id", "_map_hash", "_keep", "_hash")
    maps = keep_bitmaps(dropped_lines(docs, min_docs, min_chars, keep_first)).select(
        F.col("doc_id").alias(of), F.col("text_hash").alias(map_hash), F.col("keep").alias(keep))
    own = docs.withColumn(own_hash, F.xxhash64("text"))
    return own.join(maps, F.col("doc_id").eqNullSafe(F.col(of))
                    & (F.col(own_hash) == F.col(map_hash)), "left").drop(of, own_hash, map_hash), keep


def _kept(text: pa.Array, keep: pa.Array) -> tuple[pa.Array, list[int], list[int]]:
    out = [apply_bitmap(t, k) for t, k in zip(text_bytes(text), keep.to_pylist(), strict=True)]
    kept = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
    return kept, [x[1] for x in out], [x[2] for x in out]


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                keep_first: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row, with the text that stays."""
    both, keep = _with_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep_first)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            text, n_lines, n_dropped = _kept(b["text"], b[keep])
            yield {"doc_id": b["doc_id"], "text": text, "n_lines": n_lines, "n_dropped": n_dropped}
    return arrow_map(both, run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                  keep_first: bool = False) -> DataFrame:
    """``docs`` without the repeated lines, all columns kept; ``n_chars`` follows the text."""
    both, keep = _with_bitmaps(docs, min_docs, min_chars, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _, dropped = _kept(b["text"], b[keep])
            text = pc.if_else(pc.is_null(b["text"]), pa.scalar(None, pa.string()), text)
            changed = pa.array(np.array(dropped, bool))
            columns = {}
            for f in target:
                columns[f.name] = b[f.name]
                if f.name == "text":
                    columns[f.name] = text.cast(f.type)
                elif f.name == "n_chars":
                    columns[f.name] = pc.if_else(changed, pc.utf8_length(text).cast(f.type), b[f.name])
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=target)
    target = to_arrow_schema(docs.schema)
    return both.mapInArrow(run, docs.schema)
