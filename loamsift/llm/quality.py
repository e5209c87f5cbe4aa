"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, all of it, cut without gaps. A passage is
described by the transitions between classes of neighbouring bytes, its share of repeated words
and its word lengths, and encoded by a learned layer. Gated attention
(softmax over passages of w . (tanh(V h) * sigmoid(U h))) weighs the passages; the weighted
passage representation is scored by a logistic unit. Only documents carry labels; encoder,
attention and scorer are trained together in numpy on a bounded sample of labelled documents.

Defined cases: null and empty text are one empty passage; without labels of both classes every
score is the share of label 1 (0 without labels); every row is scored on its own; other
columns are left out or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loamsift.llm.common import NOT_SPACE, WordHasher, arrow_map, chunks, ranges, text_bytes
from loamsift.llm.labelled import Adam, training_rows

PASSAGE = 512
CLASSES = 22
FEATURES = CLASSES * CLASSES + 4
HIDDEN, ATTENTION = 32, 16
PER_CLASS = 2_500  # labelled documents of each class at most
FIT_PASSAGES = 64  # passages of one document that the fit sees at most, evenly drawn; scores see all
EPOCHS, BATCH, RATE, DECAY = 12, 100, 0.004, 1e-4


def _byte_classes() -> np.ndarray:
    c = np.full(256, 1, np.int64)  # other control bytes
    c[32], c[10], c[9] = 2, 3, 2
    c[33:127] = 4  # other signs
    for i, signs in enumerate((b".", b",", b"!?", b"#", b"$", b"%", b"&", b"*", b"|", b"<>", b"/\\",
                               b"-_=~", b"\"'", b":;", b"()[]{}")):
        c[list(signs)] = 5 + i
    c[48:58], c[65:91], c[97:123] = 20, 21, 0
    c[128:] = 0  # letters of other alphabets count as small letters
    return c


_CLASS = _byte_classes()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and each text's first passage (and the end)."""
    sizes = np.array([len(t) for t in texts])
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    owner = first[doc] + (np.arange(len(buf)) - start[doc]) // PASSAGE
    code = _CLASS[buf]
    pair = np.zeros(len(buf), np.int64)
    pair[:-1] = code[:-1] * CLASSES + code[1:]
    inside = np.zeros(len(buf), bool)
    inside[:-1] = owner[1:] == owner[:-1]
    total = int(first[-1])
    grid = np.bincount(owner[inside] * (CLASSES * CLASSES) + pair[inside],
                       minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float32)
    length = np.bincount(owner, minlength=total).astype(np.float32)
    grid = np.sqrt(grid / np.maximum(length, 1)[:, None])
    words, at = WordHasher(NOT_SPACE)([buf[start[i] + j * PASSAGE:
                                           min(start[i] + (j + 1) * PASSAGE, start[i] + sizes[i])].tobytes()
                                       for i in range(len(texts)) for j in range(n[i])])
    count = np.diff(at)
    holder = np.repeat(np.arange(total), count)
    order = np.lexsort((words, holder))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (holder[order][1:] != holder[order][:-1])
    distinct = np.bincount(holder[order][fresh], minlength=total)
    some = np.maximum(count, 1)
    extra = np.stack([distinct / some, np.log1p(length / some), np.log1p(length) / 6,
                      np.log1p(np.repeat(sizes, n)) / 10], axis=1).astype(np.float32)
    return np.concatenate([grid, extra], axis=1), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """All parts of the model for bags of passages ``x[first[i]:first[i + 1]]``."""
    h = np.tanh(((x - p["mean"]) * p["scale"]) @ p["encode"] + p["encode_bias"])
    gate, value = _sigmoid(h @ p["u"]), np.tanh(h @ p["v"])
    e = (gate * value) @ p["w"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(h * a[:, None], first[:-1])
    return {"h": h, "gate": gate, "value": value, "a": a, "bag": bag, "z": z,
            "p": _sigmoid(z @ p["out"] + p["bias"])}


def gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = forward(p, x, first)
    d = (f["p"] - y) * weight / len(y)
    dz = d[:, None] * p["out"]
    by_row = dz[f["bag"]]
    da = (by_row * f["h"]).sum(axis=1)
    mean = np.add.reduceat(da * f["a"], first[:-1])[f["bag"]]
    de = f["a"] * (da - mean)
    dgv = de[:, None] * p["w"]
    dgate = dgv * f["value"] * f["gate"] * (1 - f["gate"])
    dvalue = dgv * f["gate"] * (1 - f["value"] ** 2)
    dh = by_row * f["a"][:, None] + dgate @ p["u"].T + dvalue @ p["v"].T
    dpre = dh * (1 - f["h"] ** 2)
    g = {"out": f["z"].T @ d, "bias": d.sum(), "w": (f["gate"] * f["value"]).T @ de,
         "u": f["h"].T @ dgate, "v": f["h"].T @ dvalue,
         "encode": ((x - p["mean"]) * p["scale"]).T @ dpre, "encode_bias": dpre.sum(axis=0)}
    return {k: v + DECAY * p[k] if k in ("encode", "u", "v", "out") else v for k, v in g.items()}


def _moments(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse spread of all passages, summed bag by bag."""
    n = sum(len(b) for b in bags)
    total, square = np.zeros((2, FEATURES))
    for b in bags:
        b = b.astype(np.float64)
        total += b.sum(axis=0)
        square += (b * b).sum(axis=0)
    mean = total / n
    return mean, 1 / (np.sqrt(np.maximum(square / n - mean * mean, 0)) + 0.02)


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Encoder, gated attention and scorer, fitted together by Adam."""
    rng = np.random.default_rng(4)
    share = float((weight * y).sum() / max(weight.sum(), 1e-9))
    known = 0 < share < 1
    p = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES),
         "encode": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)),
         "encode_bias": np.zeros(HIDDEN), "u": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
         "v": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.2, ATTENTION),
         "out": rng.normal(0, 0.2, HIDDEN) if known else np.zeros(HIDDEN),
         "bias": np.array(np.log(share / (1 - share)) if known else (60.0 if share else -60.0))}
    if known:
        p["mean"], p["scale"] = _moments(bags)
        weight = weight / weight.mean()
        step = Adam(RATE)
        for epoch in range(epochs):
            step.rate = RATE * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(y)), max(1, -(-len(y) // BATCH))):
                own = [bags[i].astype(np.float32) for i in part]
                first = np.concatenate([[0], np.cumsum([len(b) for b in own])])
                step(p, gradients(p, np.concatenate(own), first, y[part], weight[part]))
    return {k: np.asarray(v, np.float32) for k, v in p.items()}


def _drawn(n: int) -> np.ndarray:
    """Places of the passages that the fit sees of a document of ``n``."""
    return np.unique(np.linspace(0, n - 1, min(n, FIT_PASSAGES)).astype(int))


def fit(docs: DataFrame, labels: DataFrame, for_training: Column,
        per_class: int = PER_CLASS) -> dict:
    rows = training_rows(docs, labels, "quality", for_training, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts, encoded = text_bytes(b["text"]), []
            for lo, hi in chunks(texts):
                x, first = passages(texts[lo:hi])
                encoded += [x[i:j][_drawn(j - i)].astype(np.float16).tobytes()
                            for i, j in zip(first[:-1], first[1:])]
            yield {"doc_id": b["doc_id"].cast(pa.string()), "y": b["y"], "weight": b["weight"],
                   "x": pa.array(encoded, pa.binary())}
    got = arrow_map(rows, run, "doc_id string, y int, weight double, x binary").toArrow().sort_by(
        "doc_id")
    # views of the Arrow buffers; a batch is widened when it is its turn
    bags = [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, FEATURES) for x in got["x"]]
    return train(bags, got["y"].to_numpy(), got["weight"].to_numpy())


def _scores(texts: list[bytes], model: dict) -> np.ndarray:
    out = [np.empty(0)]
    for lo, hi in chunks(texts):
        out.append(forward(model, *passages(texts[lo:hi]))["p"])
    return np.concatenate(out)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": _scores(text_bytes(b["text"]), sent.value)}
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The documents with a score of at least ``least``; all columns stay, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(text_bytes(b["text"]), sent.value) >= least))
    return docs.mapInArrow(run, docs.schema)
