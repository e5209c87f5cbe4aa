"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model with a Dirichlet prior,
P(w | v) = (c(vw) + MU * P(w)) / (c(v) + MU), over additively smoothed unigrams
P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); a document is its words and one end, and the end also
stands before the first word. All counts cover all training documents.

Documents are coded in batches of about ``BATCH_BYTES`` of text: a local list of word hashes
and the tokens as places in it. A batch asks each shard once for each of its distinct words,
then once for each of its distinct word pairs, and adds its own training counts to the question.
So counting and looking up are one exchange, a word or pair costs one entry a batch however
often it occurs, and pairs are dealt by a hash of both words: neither a very common word nor a
very common pair makes a hot shard. Shards grow in number with the tokens.

A shard of pairs builds its part of the trie: contexts and pointers as monotone Elias-Fano
sequences; the successors of each context, lifted by the context's base into one monotone
sequence; and 16-bit codes of the smoothed probabilities. The levels are written to a temporary
file, memory-mapped, asked by context-relative successor search and removed. Pairs without
training count are answered by the prior.

Defined cases: null text is empty and scores its end; a null doc_id is a training document; every
row counts, also repeated ones; without training tokens N and V are 0; other columns are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.llm.common import NOT_SPACE, WordHasher, arrow_map, chunks, mix, text_bytes
from loamsift.session import stash

MU = 100.0
BATCH_BYTES = 12 << 20
SHARD_WORDS = 1_000_000  # distinct words of batches in a shard, about
SHARD_TOKENS = 2_500_000  # tokens whose pairs are in a shard, about
STEPS = 4000  # codes of a probability for each power of ten
END = np.uint64(0x5BD1E995C0FFEE11)  # hash of the end


def pack(a: np.ndarray, kind: str) -> bytes:
    """Compressed bytes of an array, byte planes apart."""
    raw = np.ascontiguousarray(a, kind).view(np.uint8).reshape(len(a), -1)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class EliasFano:
    """A non-decreasing sequence of whole numbers: packed low bits and unary high parts."""

    def __init__(self, parts: dict[str, np.ndarray], n: int, low_bits: int):
        self.low, self.n, self.bits = parts["low"], n, low_bits
        ones = np.flatnonzero(np.unpackbits(parts["high"]))[:n]
        high = ones - np.arange(n)
        self.start = np.searchsorted(high, np.arange(int(high[-1]) + 2 if n else 1))
        self.high = high

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        low = (values & ((1 << bits) - 1)).astype(np.uint64)
        flat = np.empty((n, bits), np.uint8)
        for i in range(bits):
            flat[:, i] = (low >> np.uint64(i)) & np.uint64(1)
        unary = np.zeros(n + (top >> bits) + 1, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        return {"low": np.concatenate([np.packbits(flat, bitorder="little"), np.zeros(9, np.uint8)]),
                "high": np.packbits(unary)}, n, bits

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at these places."""
        place = at * self.bits
        word = np.zeros(len(at), np.uint64)
        for i in range((self.bits + 14) // 8):
            word |= self.low[(place >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
        low = (word >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        return (self.high[at] << self.bits) + low.astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not below each x; n when there is none."""
        part = np.minimum(x >> self.bits, len(self.start) - 1)
        lo = self.start[part]
        hi = self.start[np.minimum(part + 1, len(self.start) - 1)]
        hi = np.where(part >= len(self.start) - 1, lo, hi)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            below = np.zeros(len(x), bool)
            below[open_] = self[mid[open_]] < x[open_]
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo


class Trie:
    """Contexts, pointers, successors and probability codes, read from one mapped file."""

    def __init__(self, folder: str, v: np.ndarray, w: np.ndarray, codes: np.ndarray):
        new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(v)]])[:len(first)] - 1
        base = np.concatenate([[0], np.cumsum(w[last] + 1)])[:len(first)]
        lifted = w + np.repeat(base, last - first + 1)
        self.file = os.path.join(folder, "trie")
        levels = {name: EliasFano.encode(x) for name, x in (
            ("contexts", v[first]), ("pointers", np.append(first, len(v))), ("bases", base),
            ("successors", lifted))}
        offset, places = 0, {}
        with open(self.file, "wb") as out:
            for name, (parts, n, bits) in levels.items():
                for part, data in parts.items():
                    places[name, part] = offset, len(data)
                    offset += out.write(data.tobytes())
            places["codes", ""] = offset, 2 * len(codes)
            out.write(codes.astype("<u2").tobytes())
        mapped = np.memmap(self.file, np.uint8, "r") if os.path.getsize(self.file) else np.empty(0, np.uint8)
        piece = lambda key: mapped[places[key][0]:places[key][0] + places[key][1]]
        for name, (_, n, bits) in levels.items():
            setattr(self, name, EliasFano({p: piece((name, p)) for p in ("low", "high")}, n, bits))
        self.codes = piece(("codes", "")).view("<u2")

    def lookup(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 where the trie has none."""
        out = np.zeros(len(v), np.uint16)
        if not self.contexts.n:
            return out
        context = np.minimum(self.contexts.successor(v), self.contexts.n - 1)
        known = np.flatnonzero(self.contexts[context] == v)
        context = context[known]
        goal = self.bases[context] + w[known]
        at = self.successors.successor(goal)
        inside = at < self.pointers[context + 1]  # else the next context's first successor
        hit = np.flatnonzero(inside)
        hit = hit[self.successors[at[hit]] == goal[hit]]
        out[known[hit]] = self.codes[at[hit]]
        return out


def coded_batches(docs: DataFrame, training: Column) -> DataFrame:
    """(batch, n_keys, n_tokens, doc_id[], size[], train[], keys, tokens) for batches of documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(ids: list[pa.Array], train: list, texts: list[bytes], number: int) -> dict:
        hasher, words, sizes = WordHasher(NOT_SPACE), [], []
        for lo, hi in chunks(texts):
            h, at = hasher(texts[lo:hi])
            ends = np.insert(h, at[1:], END)
            words.append(ends)
            sizes.append(np.diff(at) + 1)
        tokens, sizes = np.concatenate(words), np.concatenate(sizes)
        keys, places, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, places = keys[order], rank[places]
        return {"batch": [number], "n_keys": [len(keys)], "n_tokens": [len(tokens)],
                "doc_id": pa.ListArray.from_arrays([0, len(sizes)], pa.concat_arrays(ids)),
                "size": pa.array([sizes.tolist()]), "train": pa.array([train]), "end": [int(np.flatnonzero(keys == END)[0])],
                "keys": [keys.tobytes()], "tokens": [pack(places, "<u4")]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for b in batches:
            own = text_bytes(b["text"])
            for lo, hi in chunks(own):
                ids.append(b["doc_id"].slice(lo, hi - lo))
                train += b["train"].slice(lo, hi - lo).to_pylist()
                texts += own[lo:hi]
                size += sum(map(len, own[lo:hi]))
                if size >= BATCH_BYTES:
                    yield encode(ids, train, texts, number)
                    ids, train, texts, size, number = [], [], [], 0, number + 1
        if texts:
            yield encode(ids, train, texts, number)
    return arrow_map(docs.select("doc_id", "text", training.alias("train")), run,
                     f"batch long, n_keys long, n_tokens long, doc_id array<{kind}>, "
                     "size array<int>, train array<boolean>, end int, keys binary, tokens binary")


_ANSWER = "batch long, shard int, at binary, a binary, b binary, tokens long, types long"


def _parts(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with its entries, in order."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(n + 1))
    for s in range(n):
        if ends[s] < ends[s + 1]:
            yield s, order[ends[s]:ends[s + 1]]


def _trained(row: dict) -> np.ndarray:
    """Which tokens of a batch are of training documents."""
    return np.repeat(np.array(row["train"], bool), np.array(row["size"]))


def word_questions(coded: DataFrame, shards: int) -> DataFrame:
    """(shard, batch, at, keys, counts): a batch's distinct words, their places and training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for row in b.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint64)
                tokens = unpack(row["tokens"], "<u4")
                counts = np.bincount(tokens[_trained(row)], minlength=len(keys))
                shard = (mix(keys) % np.uint64(shards)).astype(int)
                for s, at in _parts(shard, shards):
                    yield {"shard": [s], "batch": [row["batch"]],
                           "at": [pack(np.diff(at, prepend=0), "<u4")], "keys": [keys[at].tobytes()],
                           "counts": [pack(counts[at], "<u4")]}
    return arrow_map(coded.select("batch", "size", "train", "keys", "tokens"), run,
                     "shard int, batch long, at binary, keys binary, counts binary")


def word_answers(questions: DataFrame, shards: int) -> DataFrame:
    """For each question the words' ids and corpus counts; and each shard's sums (batch -1)."""
    schema = _schema(_ANSWER)

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, np.concatenate([unpack(r["counts"], "<u4") for r in rows])
                            ).astype(np.int64)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))  # frequent words: small ids
        s = rows[0]["shard"]
        out, at = [{"batch": -1, "shard": s, "at": b"", "a": b"", "b": b"", "tokens": int(count.sum()),
                    "types": int((count > 0).sum())}], 0
        for r, k in zip(rows, keys, strict=True):
            p = place[at:at + len(k)]
            at += len(k)
            out.append({"batch": r["batch"], "shard": s, "at": r["at"],
                        "a": pack(rank[p] * shards + s, "<u8"),
                        "b": pack(count[p], "<u8"), "tokens": 0, "types": 0})
        return pa.Table.from_pylist(out, schema=schema)
    return questions.groupBy("shard").applyInArrow(answer, _ANSWER)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _learned(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and corpus counts of a batch's words; answers come with the places they are for."""
    at, ids, counts = (np.concatenate(x) for x in zip(*[
        (np.cumsum(unpack(r["at"], "<u4").astype(np.int64)), unpack(r["a"], "<u8").astype(np.int64),
         unpack(r["b"], "<u8").astype(np.int64)) for r in answers]))
    order = np.argsort(at)
    return ids[order], counts[order]


class BatchPairs:
    """Distinct word pairs of a batch, by id of the first and then of the second word."""

    def __init__(self, row: dict, answers: list[dict], pair_shards: int):
        ids, counts = _learned(answers)
        order = np.argsort(ids)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids, self.counts = ids[order], counts[order]
        self.tokens = rank[unpack(row["tokens"], "<u4")]
        before = np.empty_like(self.tokens)
        before[0] = rank[row["end"]]
        before[1:] = self.tokens[:-1]
        n = len(ids)
        before *= n
        before += self.tokens
        code, self.place = np.unique(before, return_inverse=True)
        self.v, self.w = code // n, code % n
        self.trained = _trained(row)
        self.shard = (mix(mix(self.ids[self.v].astype(np.uint64)) + self.ids[self.w].astype(
            np.uint64)) % np.uint64(pair_shards)).astype(int)


def _log_p1(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))


def _by_batch(coded: DataFrame, *answers: DataFrame) -> DataFrame:
    """Coded batches, without their words, and answers, one group a batch."""
    frames = [coded.drop("keys").withColumn("level", F.lit(0))] + [
        a.select("batch", "shard", "at", "a", "b").withColumn("level", F.lit(i + 1))
        for i, a in enumerate(answers)]
    joined = frames[0]
    for f in frames[1:]:
        joined = joined.unionByName(f, allowMissingColumns=True)
    return joined.groupBy("batch")


def _split(t: pa.Table) -> tuple[dict, list[list[dict]]]:
    rows = t.to_pylist()
    own = next(r for r in rows if r["level"] == 0)
    return own, [[r for r in rows if r["level"] == i] for i in (1, 2)]


def pair_questions(coded: DataFrame, words: DataFrame, pair_shards: int) -> DataFrame:
    """(shard, batch, v, w, counts, cv, cw): a batch's distinct pairs for each shard."""
    ddl = "shard int, batch long, v binary, w binary, counts binary, cv binary, cw binary"
    schema = _schema(ddl)

    def ask(t: pa.Table) -> pa.Table:
        row, (answers, _) = _split(t)
        p = BatchPairs(row, answers, pair_shards)
        counts = np.bincount(p.place[p.trained], minlength=len(p.v))
        out = []
        for s, at in _parts(p.shard, pair_shards):
            first = p.ids[p.v[at]]
            out.append({"shard": s, "batch": row["batch"],
                        "v": pack(np.diff(first, prepend=0), "<u8"), "w": pack(p.ids[p.w[at]], "<u8"),
                        "counts": pack(counts[at], "<u4"), "cv": pack(p.counts[p.v[at]], "<u8"),
                        "cw": pack(p.counts[p.w[at]], "<u8")})
        return pa.Table.from_pylist(out, schema=schema)
    return _by_batch(coded, words).applyInArrow(ask, ddl)


def pair_answers(questions: DataFrame, n: int, types: int) -> DataFrame:
    """For each question the codes of its pairs, from the shard's part of the trie."""
    schema = _schema(_ANSWER)

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        asked = [(np.cumsum(unpack(r["v"], "<u8").astype(np.int64)), unpack(r["w"], "<u8").astype(np.int64))
                 for r in rows]
        v, w = (np.concatenate([x[i] for x in asked]) for i in (0, 1))
        counts, cv, cw = (np.concatenate([unpack(r[c], k) for r in rows])
                          for c, k in (("counts", "<u4"), ("cv", "<u8"), ("cw", "<u8")))
        order = np.lexsort((w, v))
        new = np.ones(len(order), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        kept = order[first][total > 0]
        total = total[total > 0]
        p = (total + MU * 10.0 ** _log_p1(cw[kept], n, types)) / (cv[kept] + MU)
        codes = np.clip(np.rint(-np.log10(p) * STEPS), 0, 65_534).astype(np.int64) + 1
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, v[kept], w[kept], codes)
            out = [{"batch": r["batch"], "shard": r["shard"], "at": b"",
                    "a": pack(trie.lookup(*own), "<u2"), "b": b"", "tokens": 0, "types": 0}
                   for r, own in zip(rows, asked, strict=True)]
            del trie
        return pa.Table.from_pylist(out, schema=schema)
    return questions.groupBy("shard").applyInArrow(answer, _ANSWER)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = stash(coded_batches(docs, training), "coded")
    size = coded.agg(F.sum("n_keys").alias("keys"), F.sum("n_tokens").alias("tokens")).first()
    word_shards = -(-(size["keys"] or 1) // SHARD_WORDS)
    pair_shards = -(-(size["tokens"] or 1) // SHARD_TOKENS)
    words = stash(word_answers(word_questions(coded, word_shards), word_shards), "words")
    sums = words.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, types = sums["n"] or 0, sums["v"] or 0
    words = words.where("batch >= 0")
    pairs = pair_answers(pair_questions(coded, words, pair_shards), n, types)
    ddl = (f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
    schema = _schema(ddl)

    def finish(t: pa.Table) -> pa.Table:
        row, (answers, coded_pairs) = _split(t)
        p = BatchPairs(row, answers, pair_shards)
        by = {r["shard"]: r for r in coded_pairs}
        code = np.zeros(len(p.v), np.int64)
        for s, at in _parts(p.shard, pair_shards):
            code[at] = unpack(by[s]["a"], "<u2")
        base = _log_p1(p.counts, n, types)
        prior = np.log10(MU / (p.counts[p.v] + MU)) + base[p.w]
        logs = np.where(code > 0, -(code - 1) / STEPS, prior)
        sizes = np.array(row["size"])
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        return pa.Table.from_arrays([
            pa.array(row["doc_id"], schema.field("doc_id").type), pa.array(row["train"]),
            pa.array(sizes.astype(np.int64)), pa.array(add((p.counts > 0)[p.tokens].astype(np.int64))),
            pa.array(np.full(len(sizes), n)), pa.array(add(base[p.tokens])),
            pa.array(add(logs[p.place]))], schema=schema)
    return _by_batch(coded, words, pairs).applyInArrow(finish, ddl)
