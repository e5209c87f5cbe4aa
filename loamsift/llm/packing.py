"""Best-fit packing with patterns fitted by non-negative least squares.

Documents become token pieces of at most ``max_len``. Packing looks at the histogram of
piece lengths only, which has ``max_len`` entries whatever the number of documents:

1. lengths are put into ``BINS`` bins and all patterns of one to four bins that fill a sequence
   are enumerated;
2. repeat counts of the patterns are fitted to the binned histogram by non-negative least
   squares and rounded; each repeat places the largest documents of its pattern (one or two, never
   the smallest) with exact lengths;
3. what is left, longest first, goes best-fit into the tightest open space, else into a new
   sequence. Equal lengths and equal spaces are handled as counts, so the work does not grow with
   the number of documents.

The plan maps (length, rank among that length) to (sequence, offset). Ranks come from a
two-level count (length, salt), so a length that a third of all pieces share is split. The
plan is sent to tasks that place their pieces by binary search.

Defined cases: null text is empty; an empty text is one piece holding the end id; every row is
packed, also repeated ones; other columns are left out.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamsift.llm.common import arrow_map, chunks, process_cache, ranges, text_bytes
from loamsift.session import stash

BINS = 64
SALT_ROWS = 20_000  # pieces of one length and salt, about
CACHED_WORDS = 1_000_000
CHUNK = 6 << 20  # bytes of text split together; longer texts go alone
JOINED = 4_096  # words of letters encoded as one text
_TAIL = ".,;:!?$%&*#|-"
_LOWER = {i: i + 32 for i in range(65, 91)}

# How a tokenizer file says that words can be encoded one by one
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class WordTokenizer:
    """Token ids of texts by their white-space separated words; ids of words seen are kept.

    This holds for tokenizers that split and normalise as ``WORD_WISE`` says: white space is
    dropped, what lies between is encoded on its own, and a run of letters is one unit whose last
    token, and no other, carries the end-of-word mark. Others encode whole texts.
    """

    def __init__(self, path: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.word_wise = all(config[k] == v for k, v in WORD_WISE.items()) and config["model"].get(
            "end_of_word_suffix") == "</w>" and not any(
            t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]]
            for t in config["added_tokens"])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(words, range(n, n + len(words))))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(ids)

    def _add_encoded(self, words: list[str]) -> None:
        found = self._encode(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add(words, size, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum())))

    def _add_letters(self, words: list[str]) -> None:
        """Words of letters only, many in one text: the marks tell where each ends."""
        for lo in range(0, len(words), JOINED):
            part = words[lo:lo + JOINED]
            ids = np.array(self._encode([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # a letter to one Unicode table and none to another
                self._add_encoded(part)
            else:
                self._add(part, np.diff(ends, prepend=0), ids)

    def _learn(self, words: list[str]) -> None:
        """Add words; letters with trailing signs are put together of their two parts."""
        whole, letters, tails, joined = [], set(), set(), []
        for w in words:
            body = w.rstrip(_TAIL)
            if body.isalpha() and (body.isascii() or body.lower().isalpha()):
                # case is ignored; only A-Z are sure to be lowered alike
                low = body.lower() if body.isascii() else body.translate(_LOWER)
                letters.add(low)
                if w != low:
                    tail = w[len(body):]
                    tails.add(tail)
                    joined.append((w, low, tail))
            else:
                whole.append(w)
        known = self.index
        self._add_letters([w for w in letters if w not in known])
        rest = {w for w in itertools.chain(whole, tails) if w not in known}
        self._add_encoded(list(rest))
        joined = [x for x in joined if x[0] not in known]
        if joined:
            at = np.array([(known[low], known[tail]) for _, low, tail in joined], np.int64)
            self._add([w for w, _, _ in joined], self.size[at].sum(axis=1),
                      self.ids[ranges(self.start[at.ravel()], self.size[at.ravel()])])

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not self.word_wise:
            for ids in self._encode([t.decode() for t in texts]):
                yield np.array(ids, np.uint32)
            return
        if len(self.index) > CACHED_WORDS:
            self._reset()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.index.get, distinct))
        if None in found:
            self._learn([w for w, at in zip(distinct, found, strict=True) if at is None])
            found = map(self.index.__getitem__, distinct)
        slot = np.fromiter(found, np.int64, len(distinct))[words.indices.to_numpy()]
        size = self.size[slot]
        ids = self.ids[ranges(self.start[slot], size)]
        # where each text's ids end: at the end of its last word
        ends = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for lo, hi in zip(ends[:-1], ends[1:]):
            yield ids[lo:hi]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's token pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept = process_cache("word_tokenizer")
        tokens = kept.get(tokenizer) or kept.setdefault(tokenizer, WordTokenizer(tokenizer))
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in chunks(texts, CHUNK):
                part = b.slice(lo, hi - lo)
                row, start, length, crc, kept_ids = [], [], [], [], []
                for i, ids in enumerate(tokens(texts[lo:hi])):
                    ids = np.append(ids, end_id).astype("<u4")
                    for at in range(0, len(ids), max_len):
                        cut = ids[at:at + max_len]
                        row.append(i)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            kept_ids.append(cut.astype(np.int32))
                out = {"doc_id": part["doc_id"].take(pa.array(row, pa.int64())),
                       "piece": np.array(start) // max_len, "start": start, "length": length,
                       "ids_crc32": crc}
                yield out | ({"ids": kept_ids} if with_ids else {})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                     + (", ids array<int>" if with_ids else ""))


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Bins (1 to ``bins``, largest first) of one to four documents that fill a sequence.

    A document is on average half a bin shorter than its bin, so n of them may have bins
    that sum to ``bins + n // 2``; all but the smallest always fit.
    """
    found: list[tuple[int, ...]] = [(bins,)]
    for n in (2, 3, 4):
        total = bins + n // 2
        stack: list[tuple[int, ...]] = [()]
        while stack:
            head = stack.pop()
            left, more = total - sum(head), n - len(head)
            top = min(head[-1] if head else bins, left - more + 1)
            if more == 1:
                if left <= top and total - left <= bins:
                    found.append((*head, left))
            else:
                stack += [(*head, b) for b in range(-(-left // more), top + 1)]
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets, one column enters at a time."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(3 * a.shape[1]):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * scale:
            break
        active[j] = True
        while active.any():
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 1e-12)
            if not low.any():
                x = z
                break
            step = min(1.0, (x[low] / np.maximum(x[low] - z[low], 1e-300)).min())
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


class Plan:
    """Where the r-th piece of each length goes; built from the histogram of lengths alone."""

    def __init__(self, counts: dict[int, int], max_len: int):
        self.max_len, self.left = max_len, dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, sequence, offset
        self.n_sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # space -> (first sequence, how many)
        self.spaces: list[int] = []
        self._fit_patterns()
        self._best_fit()
        self.rows.sort()

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _opened(self, space: int, sequence: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in self.open:
                self.open[space] = []
                insort(self.spaces, space)
            self.open[space].append((sequence, n))

    def _fit_patterns(self) -> None:
        width = -(-self.max_len // BINS)
        bins = -(-self.max_len // width)
        bin_of = lambda length: -(-length // width)
        have = np.zeros(bins)
        for length, n in self.left.items():
            have[bin_of(length) - 1] += n
        forms = patterns(bins)
        a = np.zeros((bins, len(forms)))
        for j, form in enumerate(forms):
            for b in form:
                a[b - 1, j] += 1
        fitted = nnls(a, have)
        for j in np.argsort(-fitted, kind="stable"):
            repeats = int(round(fitted[j]))
            if repeats and len(forms[j]) > 1:
                self._place(forms[j][:min(2, len(forms[j]) - 1)], repeats, bin_of)

    def _place(self, heads: tuple[int, ...], repeats: int, bin_of) -> None:
        """The given bins into ``repeats`` new sequences, as far as the bins have documents."""
        need = {b: heads.count(b) for b in heads}
        stock = {b: sorted(x for x, n in self.left.items() if n and bin_of(x) == b) for b in need}
        repeats = min([repeats, *(sum(self.left[x] for x in stock[b]) // k
                                  for b, k in need.items())])
        while repeats:
            # long ones of one bin beside short ones of the next, so that sums are alike
            chosen, taken = [], defaultdict(int)
            for i, b in enumerate(heads):
                order = stock[b] if i % 2 else stock[b][::-1]
                x = next(x for x in order if self.left[x] > taken.get(x, 0))
                chosen.append(x)
                taken[x] += 1
            if sum(chosen) > self.max_len:  # the last bin may reach past the end
                return
            n = min(repeats, *(self.left[x] // k for x, k in taken.items()))
            offset = 0
            for x in chosen:
                self._put(x, n, self.n_sequences, offset)
                offset += x
            self._opened(self.max_len - offset, self.n_sequences, n)
            self.n_sequences += n
            repeats -= n

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                n, at = self.left[length], bisect_left(self.spaces, length)
                if at == len(self.spaces):
                    fit = self.max_len // length
                    whole = n // fit
                    each, many = (fit, whole) if whole else (n, 1)
                    for i in range(each):
                        self._put(length, many, self.n_sequences, i * length)
                    self._opened(self.max_len - each * length, self.n_sequences, many)
                    self.n_sequences += many
                    continue
                space = self.spaces[at]
                sequence, many = self.open[space].pop()
                take = min(n, many)
                if take < many:
                    self.open[space].append((sequence + take, many - take))
                elif not self.open[space]:
                    del self.open[space], self.spaces[at]
                self._put(length, take, sequence, self.max_len - space)
                self._opened(space - length, sequence, take)


_RANKS = 40  # bits for a rank beside the length


def _ranked(cut: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of a length; no length is one group."""
    salts = max(1, cut.count() // SALT_ROWS)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    salted = cut.withColumn("salt", F.pmod(order, F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy(
        "salt")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "salt").orderBy(order, "doc_id", "piece")
    return salted.withColumn("r", F.row_number().over(within) - 1).join(
        before, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r")).drop(
        "salt", "base", "r")


def pack(cut: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``; offsets have no gaps."""
    cut = stash(cut, "pieces")
    counts = {r["length"]: r["n"] for r in
              cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= max_len rows
    plan = Plan(counts, max_len).rows
    key = np.array([(x[0] << _RANKS) + x[1] for x in plan], np.int64)
    rank0, sequence, offset = (np.array([x[i] for x in plan], np.int64) for i in (1, 2, 3))
    sent = cut.sparkSession.sparkContext.broadcast((key, rank0, sequence, offset))
    columns = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, rank0, sequence, offset = sent.value
        for b in batches:
            rank = b["rank"].to_numpy()
            at = np.searchsorted(key, (b["length"].to_numpy() << _RANKS) + rank, "right") - 1
            yield {**{c: b[c] for c in columns}, "sequence_id": sequence[at] + rank - rank0[at],
                   "offset": offset[at]}
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return arrow_map(_ranked(cut), run, f"{fields}, sequence_id long, offset long")
