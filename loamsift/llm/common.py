"""Shared helpers: word hashes of whole batches of text, shingles, plain Arrow access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = b" \t\n\r\x0b\x0c"  # [\x20\x09-\x0D]
CHUNK_BYTES = 2 << 20  # text hashed at a time inside a task; longer texts go alone
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(folds: int, fold: int) -> Column:
    """crc32 of the doc_id as text falls into ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
              schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of arrays in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [v.cast(t.type) if isinstance(v, pa.Array) else pa.array(v, t.type)
                      for v, t in zip(columns.values(), target, strict=True)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(salt << 20)) * _U(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = seeds(256, 7) | _U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z


def word_table(letters_only: bool) -> np.ndarray:
    """Which bytes belong to words: all but white space, or ASCII letters, digits and non-ASCII."""
    t = np.ones(256, bool)
    if letters_only:
        t[:128] = False
        t[48:58] = t[65:91] = t[97:123] = True
    else:
        t[list(SPACE)] = False
    return t


NOT_SPACE, ALPHANUMERIC = word_table(False), word_table(True)


class WordHasher:
    """64-bit hashes of all words of a list of texts, A-Z taken as a-z.

    A word's hash is a polynomial in its bytes, read off one running sum over the whole
    chunk, so the cost is a few vector operations a byte and no object per word.
    """

    def __init__(self, is_word: np.ndarray):
        self.is_word, self.size = is_word, 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + (1 << 16))
            step = np.full(self.size, _BASE, _U)
            step[0] = 1
            self.up = np.cumprod(step)
            step[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(step)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and each text's first word (one more entry: the end)."""
        buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        self._powers(len(buf))
        inside = self.is_word[buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]  # the word is buf[start + 1:end + 1]
        run = np.cumsum(_BYTES[buf] * self.up[:len(buf)])
        h = mix((run[ends] - run[starts]) * self.down[starts])
        first = np.cumsum([1] + [len(t) + 1 for t in texts])
        return h, np.searchsorted(starts, first - 1)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``limit`` bytes together."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles in order, and each text's first (and the end).

    A text of fewer words is one shingle; a text without words has none.
    """
    place = seeds(k, 11) | _U(1)
    n = np.diff(at)
    total = np.zeros(max(0, len(words) - k + 1), _U)
    for j in range(k):
        total += words[j:len(words) - k + 1 + j] * place[j] if len(total) else _U(0)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1], _U)
    long = n >= k
    if long.any():
        take = ranges(at[:-1][long], counts[long])
        out[ranges(first[:-1][long], counts[long])] = mix(total[take])
    for i in np.flatnonzero((n > 0) & ~long):
        w = words[at[i]:at[i + 1]]
        out[first[i]] = mix(np.array([(w * place[:len(w)]).sum() + _U(len(w))], _U))[0]
    return out, first


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + skip


def process_cache(name: str) -> dict:
    """A dict that lives as long as the worker process, shared by its tasks."""
    import sys
    import types
    holder = sys.modules.setdefault("_loamsift_process_cache", types.ModuleType("cache"))
    return holder.__dict__.setdefault(name, {})
