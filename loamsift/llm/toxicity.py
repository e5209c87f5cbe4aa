"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (with borders, hashed into
``BUCKETS`` rows) and of the whole word; a document is the mean of its words; a linear softmax
scores it. Vectors and softmax are trained jointly in numpy on a bounded sample of labelled
documents, so a misspelling never seen shares most of its n-gram vectors with the known word.
Since all means are linear, scoring needs one number a word, kept per worker.

Defined cases: null and empty text score as a document without words (the prior alone); without
labels of both classes every score is the share of label 1 (0 without labels); every row is
scored on its own; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loamsift.llm.common import arrow_map, mix, process_cache, seeds, text_bytes
from loamsift.llm.labelled import Adam, training_rows

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
PER_CLASS = 2_500  # labelled documents of each class at most
EPOCHS = 12
STEPS = 160  # a small sample is passed more often, so that training takes so many steps
SCALE = 100.0  # keeps vectors small beside the mean of hundreds of words
BATCH = 250
RATE = 0.1
DECAY = 1e-4
CACHED_WORDS = 400_000
_OUTER = b".,;:!?\"'()[]{}|$%&*#"


def words_of(text: bytes) -> list[bytes]:
    """White-space words, A-Z lower-cased, without signs at their ends."""
    return [w for w in (x.strip(_OUTER) for x in text.lower().split()) if w]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each word, whole word included, and each word's first."""
    joined = "".join(f"<{w.decode('utf-8', 'replace')}>" for w in words)
    lengths = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words])
    chars = mix(np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
                + np.uint64(1))
    end = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = end[word] - np.arange(len(chars))  # characters up to the word's end
    place = seeds(max(GRAMS), 41) | np.uint64(1)
    buckets, owners = [], []
    for n in GRAMS:
        h = np.zeros(len(chars), np.uint64)
        for j in range(n):
            h[:len(chars) - j] += chars[j:] * place[j]
        at = np.flatnonzero(left >= n)
        buckets.append(mix(h[at] + np.uint64(n)))
        owners.append(word[at])
    up = np.cumprod(np.full(int(lengths.max(initial=1)), place[1], np.uint64))
    whole = np.add.reduceat(chars * up[lengths[word] - left], end - lengths)
    buckets.append(mix(whole))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words) + 1))
    return (np.concatenate(buckets)[order] % np.uint64(BUCKETS)).astype(np.int64), first


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their weights, which sum to 1."""
    counts = Counter(words_of(text))
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    buckets, first = subwords(list(counts))
    n = np.diff(first)
    w = np.repeat(np.fromiter(counts.values(), float, len(counts)) / n, n)
    total = np.bincount(buckets, w, BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total.sum()).astype(np.float32)


class Batch:
    """Bags of some documents in row order and, for the gradient, in bucket order."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: np.ndarray):
        self.y, self.w = y, w
        size = np.array([len(b[0]) for b in bags])
        self.some = np.flatnonzero(size)
        self.at = np.cumsum(size[self.some]) - size[self.some]
        bucket = np.concatenate([b[0] for b in bags])
        self.value = np.concatenate([b[1] for b in bags])
        row = np.repeat(np.arange(len(bags)), size)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.bucket, self.row_of, self.value_of = bucket, row[order].astype(np.int32), self.value[order]
        sorted_buckets = bucket[order]
        self.start = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]])
                                    ) if len(bucket) else np.empty(0, int)
        self.rows = sorted_buckets[self.start]

    def means(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), vectors.shape[1]))
        if len(self.some):
            out[self.some] = np.add.reduceat(vectors[self.bucket] * self.value[:, None], self.at)
        return out


def train(bags: list, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Jointly fitted vectors, softmax weights and bias (of class 1 against class 0)."""
    rng = np.random.default_rng(10)
    p = {"vectors": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
         "softmax": rng.normal(0, 0.5, (DIM, 2)), "bias": np.zeros(2)}
    share = float((weight * y).sum() / max(weight.sum(), 1e-9))
    if not 0 < share < 1:
        p["vectors"][:] = 0
        p["bias"][:] = (0, 50.0 if share else -50.0)
        return p
    p["bias"][1] = np.log(share / (1 - share))
    order = rng.permutation(len(y))
    weight = weight / weight.mean()
    batches = [Batch([bags[i] for i in part], y[part], weight[part])
               for part in np.array_split(order, max(1, -(-len(y) // BATCH)))]
    epochs = max(epochs, -(-STEPS // len(batches)))
    step = Adam(RATE)
    for epoch in range(epochs):
        step.rate = RATE * (1 - epoch / epochs)
        for b in batches:
            h = b.means(p["vectors"]) * SCALE
            z = h @ p["softmax"] + p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(b.y)), b.y] -= 1
            d *= (b.w / len(b.y))[:, None]
            dh = ((d @ p["softmax"].T) * SCALE).astype(np.float32)
            g = DECAY * p["vectors"]
            if len(b.rows):
                g[b.rows] = np.add.reduceat(dh[b.row_of] * b.value_of[:, None], b.start)
            step(p, {"vectors": g, "softmax": h.T @ d, "bias": d.sum(axis=0)})
    return p


def bucket_scores(p: dict) -> tuple[np.ndarray, float]:
    """Each bucket's part of the log odds of class 1, and the bias."""
    turn = p["softmax"][:, 1] - p["softmax"][:, 0]
    return (p["vectors"] @ turn) * SCALE, float(p["bias"][1] - p["bias"][0])


def fit(docs: DataFrame, labels: DataFrame, for_training: Column,
        per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, "toxic", for_training, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            bags = [bag(t) for t in text_bytes(b["text"])]
            yield {"doc_id": b["doc_id"].cast(pa.string()), "y": b["y"], "weight": b["weight"],
                   "bucket": pa.array([x[0].tobytes() for x in bags], pa.binary()),
                   "value": pa.array([x[1].tobytes() for x in bags], pa.binary())}
    got = arrow_map(rows, run, "doc_id string, y int, weight double, bucket binary, value binary"
                    ).toArrow().sort_by("doc_id")
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in
            zip(got["bucket"].to_pylist(), got["value"].to_pylist(), strict=True)]
    return bucket_scores(train(bags, got["y"].to_numpy(), got["weight"].to_numpy()))


class WordScores(dict):
    """Log odds by word; the words of a batch that are new are added together."""

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.scores = scores

    def learn(self, words: set[bytes]) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            buckets, first = subwords(new)
            sums = np.add.reduceat(self.scores[buckets], first[:-1])
            self.update(zip(new, (sums / np.diff(first)).tolist()))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scores, bias = sent.value
        kept = process_cache("toxic_words")
        key = hash(scores.tobytes())
        if key not in kept:
            kept.clear()
            kept[key] = WordScores(scores)
        table = kept[key]
        for b in batches:
            out = []
            for lo in range(0, len(b), 200):
                texts = [words_of(t) for t in text_bytes(b["text"].slice(lo, 200))]
                table.learn({w for words in texts for w in words})
                out += [sum(map(table.__getitem__, words)) / max(1, len(words)) for words in texts]
            odds = np.clip(np.array(out) + bias, -500, 500)
            yield {"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-odds))}
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
