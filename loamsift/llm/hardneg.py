"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves, each with its own codebook (k-means on a bounded sample of about
``SAMPLE_ENTRIES`` entries, drawn by a hash of the row); the pair of nearest codewords is a row's
cell. Every row is indexed. An anchor's score with any row of a cell is at most the sum of two half
bounds, ``q.c + |q| r`` with the radius r of the codeword's rows, so a heap over the two sorted
lists of half bounds (the multi-sequence walk) visits cells in falling order of their bound.

The walk runs twice. The first finds each anchor's positives and ends once the next bound is below
the last of them. Their scores open one window for each positive; the second walk collects the best
rows of another label inside each window and ends when every window is certified: full, with no
unvisited row that could come before its last one, or wholly above the next bound.

Rows lie in waves by a hash, each sixteen times the one before, so the bounds found in a wave go with
the anchors into the next one and a task returns only rows that beat them: about sixteen rows for
each wanted one in every wave, however many tasks there are. Inside a wave rows are range-partitioned
by cell and a salt, so a hot cell is split. Anchors go out in portions of ``ANCHORS`` vectors, results
stay in tables.

Defined cases: rows with a null id, a null label, a null vector, null or non-finite components, or
entries outside 62 bits after scaling take no part. Vectors of different lengths, and empty ones, are
never compared. Rows with an anchor's own id take no part for it; repeated rows with one id count as
rows, and each repeated anchor row is mined on its own. A window whose lower end is above its upper
end (a negative positive score) is empty. Ties go to the smaller id. Labels are whole numbers. Other
columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.llm.common import arrow_map
from loamsift.session import scratch_path, stash

PART = 8_192  # rows of a part, about
ANCHORS = 8_192  # anchor vectors sent at a time
CELL = 128  # rows of a cell, about, as far as MAX_CODES allows
WAITING = 1 << 18  # offered rows ranked together, about
MAX_CODES = 32  # codewords of one half
SAMPLE_ENTRIES = 1 << 20  # entries (rows x length) of the sample that codebooks are fitted on


def usable(df: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, v, anchor) of the rows that take part; v: floor(scale * x)."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < 2.0 ** 62))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                    & F.col("embedding").isNotNull() & fits)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def codebook(sample: np.ndarray, n_codes: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of the sorted sample; codewords that lose all rows stay."""
    sample = np.unique(sample, axis=0).astype(np.float64)
    codes = sample[np.linspace(0, len(sample) - 1, min(n_codes, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, codes)
        for j in np.unique(own):
            codes[j] = sample[own == j].mean(axis=0)
    return codes


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((codes * codes).sum(axis=1) - 2 * (x.astype(np.float64) @ codes.T)).argmin(axis=1)


def multi_sequence(first: list[float], second: list[float]) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs of two falling lists, in falling order of the sum."""
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, i, j
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


class Best:
    """The k best (score, id) of every slot, as far as offered, from a lower bound on."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.slot, self.score, self.name = (np.empty(0, t) for t in (np.int64, floor.dtype, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, slot: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        self.waiting.append((slot, score, name))
        if sum(len(w[0]) for w in self.waiting[-64:]) > WAITING:
            self.settle()

    def settle(self) -> None:
        """Rank what was offered and raise the bounds."""
        if not self.waiting:
            return
        slot, score, name = (np.concatenate(c) for c in zip(
            (self.slot, self.score, self.name), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep, last = place < self.k, place == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        self.slot, self.score, self.name = slot[keep], score[keep], name[keep]


class MultiIndex:
    """The cells of a batch of rows, and the walk of anchors over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes, codebooks):
        order = np.lexsort(codes[::-1])
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        own = [c[order] for c in codes]
        self.cut = codebooks[0].shape[1]
        self.used, self.radius, inverse = [], [], []
        for half, (c, book) in enumerate(zip(own, codebooks, strict=True)):
            used, back = np.unique(c, return_inverse=True)
            part = self.x[:, self.cut:] if half else self.x[:, :self.cut]
            far = np.sqrt(((part.astype(np.float64) - book[c]) ** 2).sum(axis=1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, back, far)
            self.used.append(book[used])
            self.radius.append(radius)
            inverse.append(back)
        key = inverse[0] * len(self.used[1]) + inverse[1]
        cells, starts = np.unique(key, return_index=True)
        self.cells = {int(k): (int(a), int(b)) for k, a, b in zip(
            cells, starts, np.append(starts[1:], len(key)), strict=True)}

    def half_bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, bounds of every anchor with every used codeword, rounding included."""
        out = []
        for part, book, radius in zip((q[:, :self.cut], q[:, self.cut:]), self.used, self.radius, strict=True):
            part = part.astype(np.float64)
            norm = np.sqrt((part * part).sum(axis=1))
            reach = np.sqrt((book * book).sum(axis=1)) + radius
            out.append(part @ book.T + norm[:, None] * (radius + 1e-12 * reach) + 1e-9)
        return out

    def walk(self, q: np.ndarray, need, visit, best: Best, work: list | None = None) -> None:
        """Visit cells for every anchor until its next bound is below ``need``(anchors).

        ``visit``(anchors, rows) offers what it finds to ``best``. Visits of a round are grouped by
        cell; a round takes twice as many cells of every anchor as the one before.
        """
        halves = self.half_bounds(q)
        sorted_codes = [np.argsort(-h, axis=1, kind="stable") for h in halves]
        falling = [np.take_along_axis(h, o, 1) for h, o in zip(halves, sorted_codes, strict=True)]
        alive = np.flatnonzero(falling[0][:, 0] + falling[1][:, 0] >= need(np.arange(len(q))))
        walks = {int(a): multi_sequence(falling[0][a].tolist(), falling[1][a].tolist()) for a in alive}
        ahead = {a: next(w) for a, w in walks.items()}
        stride, visited, wide = 2, 0, len(self.used[1])
        while ahead:
            least = dict(zip(ahead, need(np.fromiter(ahead, np.int64, len(ahead))), strict=True))
            visits: dict[int, list[int]] = {}
            for a in list(ahead):
                bound, i, j = ahead[a]
                first, second, walk, floor = sorted_codes[0][a], sorted_codes[1][a], walks[a], least[a]
                taken = 0
                while bound >= floor:
                    cell = int(first[i]) * wide + int(second[j])
                    if cell in self.cells:
                        visits.setdefault(cell, []).append(a)
                        taken += 1
                    bound, i, j = next(walk, (None, 0, 0))
                    if bound is None or taken == stride:
                        break
                if bound is None or bound < floor:
                    del ahead[a]
                else:
                    ahead[a] = bound, i, j
            for cell, anchors in visits.items():
                visited += len(anchors)
                visit(np.array(anchors), slice(*self.cells[cell]))
            best.settle()
            stride *= 2
        if work is not None:
            work.append((visited, len(q) * len(self.cells)))


def find_positives(index: MultiIndex, anchors, best: Best, work: list | None = None) -> None:
    """Offer rows of the anchors' labels, as far as they may be among the best."""
    ids, labels, q = anchors
    kind = best.floor.dtype

    def visit(a: np.ndarray, rows: slice) -> None:
        s = q[a].astype(kind) @ index.x[rows].astype(kind).T
        good = (labels[a][:, None] == index.labels[rows]) & (ids[a][:, None] != index.ids[rows]) \
            & (s >= best.floor[a][:, None])
        at, row = np.nonzero(good)
        if len(at):
            best.offer(a[at], s[at, row], index.ids[rows][row])
    index.walk(q, lambda a: best.floor[a], visit, best, work)


def find_in_windows(index: MultiIndex, anchors, windows, best: Best, work: list | None = None) -> None:
    """Offer rows of other labels inside the windows (anchor, high), one slot each.

    The lower end of a window is the first bound of its slot.
    """
    ids, labels, q = anchors
    owner, high = windows
    kind = best.floor.dtype
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(q) + 1))

    def need(a: np.ndarray) -> np.ndarray:
        """The lowest score that could still change one of the anchor's windows."""
        out = np.full(len(q), float("inf") if kind != object else 1 << 200, kind)
        np.minimum.at(out, owner, best.floor)
        return out[a]

    def visit(a: np.ndarray, rows: slice) -> None:
        s = q[a].astype(kind) @ index.x[rows].astype(kind).T
        other = (labels[a][:, None] != index.labels[rows]) & (ids[a][:, None] != index.ids[rows])
        counts = first[a + 1] - first[a]
        slots = order[np.concatenate([np.arange(first[i], first[i + 1]) for i in a])]
        line = np.repeat(np.arange(len(a)), counts)
        s, other = s[line], other[line]
        at, row = np.nonzero(other & (s >= best.floor[slots][:, None]) & (s <= high[slots][:, None]))
        if len(at):
            best.offer(slots[at], s[at, row], index.ids[rows][row])
    index.walk(q, need, visit, best, work)


def _indexes(batches: Iterator[pa.RecordBatch], dim: int, books) -> Iterator[MultiIndex]:
    for b in batches:
        if b.num_rows:
            yield MultiIndex(b["vec_id"].to_numpy(), b["label"].to_numpy(), _matrix(b["v"], dim),
                             [b["code1"].to_numpy(), b["code2"].to_numpy()], books)


def _build(rows: DataFrame, dim: int, n: int) -> tuple[str, int, list[np.ndarray]]:
    """Write the index of all rows of one length; (path, waves, codebooks)."""
    spark = rows.sparkSession
    cut = max(1, dim // 2)
    every = max(1, n * dim // SAMPLE_ENTRIES)
    sample = _matrix(rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("v").toArrow()["v"]
                     .combine_chunks(), dim)
    if not len(sample):  # a hash of few rows may leave none
        sample = _matrix(rows.select("v").limit(1).toArrow()["v"].combine_chunks(), dim)
    n_codes = int(np.clip(np.sqrt(n / CELL), 1, MAX_CODES))
    books = [codebook(sample[:, :cut], n_codes), codebook(sample[:, cut:], n_codes)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = _matrix(b["v"], dim)
            yield {**{c: b[c] for c in ("row", "vec_id", "label", "v")},
                   "code1": nearest(x[:, :cut], books[0]), "code2": nearest(x[:, cut:], books[1])}
    waves = 1
    while PART * 16 ** (waves - 1) < n:
        waves += 1
    salt = F.xxhash64("row")
    wave = F.lit(waves - 1)
    for w in range(waves - 1, 0, -1):  # one row in 16^w comes before wave ``waves - w``
        wave = F.when(F.pmod(salt, F.lit(16 ** w)) == 0, F.least(wave, F.lit(waves - 1 - w))).otherwise(wave)
    kind = rows.schema["vec_id"].dataType.simpleString()
    index = arrow_map(rows.drop("anchor"), coded,
                      f"row long, vec_id {kind}, label long, v array<bigint>, code1 int, code2 int")
    path = scratch_path(spark, "multi_index")
    (index.withColumn("wave", wave).withColumn("salt", salt)
     .repartitionByRange(-(-n // PART), "wave", "code1", "code2", "salt")
     .sortWithinPartitions("wave", "code1", "code2")
     .drop("salt", "row").write.partitionBy("wave").parquet(path))
    return path, waves, books


def _best_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3,
         low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A window holds scores with ``low * positive <= 100 * score <= high * positive``.
    """
    spark = df.sparkSession
    rows = stash(usable(df.select("vec_id", "embedding", "label", is_anchor.alias("anchor")),
                        F.col("anchor"), scale), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = scratch_path(spark, "hard_negatives")
    schema = (f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, "
              "positive_score long, negative_score long")
    spark.createDataFrame([], schema).write.parquet(f"{out}/part=none")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"),
        F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("largest")).where("dim > 0 AND anchors > 0")
    for r in lengths.orderBy("dim").collect():  # a row for each vector length
        dim, portions = r["dim"], -(-r["anchors"] // ANCHORS)
        # whole numbers in floating point are exact below 2^53; beyond, Python's integers serve
        number = np.float64 if r["largest"] ** 2 * dim < 2 ** 53 else object
        own = rows.where(F.size("v") == dim)
        path, waves, books = _build(own, dim, r["n"])
        index = [spark.read.parquet(path).where(F.col("wave") == w) for w in range(waves)]
        for portion in range(portions):
            asked = own.where(F.col("anchor") & (
                F.pmod(F.xxhash64("row"), F.lit(portions)) == portion)).toArrow()
            if asked.num_rows:
                part = _mine_portion(spark, index, books, dim, asked, number, n_positives, n_negatives, low, high)
                part.write.parquet(f"{out}/part={dim}-{portion}")
    return spark.read.schema(schema).parquet(*_parts(spark, out))


def _parts(spark, out: str) -> list[str]:
    """The written parts, so that their folder names do not become a column."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in listed)


def _mine_portion(spark, index, books, dim, asked, number, n_positives, n_negatives, low, high) -> DataFrame:
    """``number``: the type that holds all scores exactly."""
    ids, labels = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
    vectors = _matrix(asked["v"].combine_chunks(), dim)
    sent = spark.sparkContext.broadcast((ids, labels, vectors, books))
    kind = index[0].schema["vec_id"].dataType.simpleString()
    m = len(ids)

    # positives: the bound of an anchor is the score of its last one so far
    nothing = -(1 << 200)
    floor = [nothing] * m
    found = None
    for wave in index:
        def run(batches: Iterator[pa.RecordBatch], floor=floor) -> Iterator[dict]:
            ids, labels, q, books = sent.value
            best = Best(np.array(floor, number), n_positives)
            for own in _indexes(batches, dim, books):
                find_positives(own, (ids, labels, q), best)
            yield {"anchor": best.slot, "anchor_id": ids[best.slot], "vec_id": best.name,
                   "score": _whole(best.score)}
        new = arrow_map(wave, run, f"anchor int, anchor_id {kind}, vec_id {kind}, score long")
        found = stash(_best_rows(new if found is None else found.unionByName(new), ["anchor"], n_positives)
                      .drop("place"), "positives")
        floor = [nothing] * m
        for r in found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(
                F.col("n") == n_positives).collect():
            floor[r["anchor"]] = r["last"]
    positives = stash(_best_rows(found, ["anchor"], n_positives), "windows")

    # negatives: one window for each positive
    rows = positives.select("anchor", "place", "score").toArrow()
    owner, place, score = (rows[c].to_numpy() for c in ("anchor", "place", "score"))
    lower = [-(-low * int(s) // 100) for s in score]  # the smallest score with 100 * score >= low * s
    upper = [high * int(s) // 100 for s in score]
    opened = np.array([i for i in range(len(score)) if lower[i] <= upper[i]], np.int64)
    bounds = [lower[i] for i in opened]
    window = spark.sparkContext.broadcast((owner[opened], place[opened], [upper[i] for i in opened]))
    found = None
    for wave in index:
        def run(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[dict]:
            ids, labels, q, books = sent.value
            owner, place, upper = window.value
            best = Best(np.array(bounds, number), n_negatives)
            spans = owner, np.array(upper, number)
            for own in _indexes(batches, dim, books) if len(owner) else ():
                find_in_windows(own, (ids, labels, q), spans, best)
            yield {"slot": best.slot, "anchor": owner[best.slot], "place": place[best.slot],
                   "vec_id": best.name, "score": _whole(best.score)}
        new = arrow_map(wave, run, f"slot int, anchor int, place int, vec_id {kind}, score long")
        found = new if found is None else found.unionByName(new)
        found = found.withColumn("rank", F.row_number().over(
            Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= n_negatives)
        found = stash(found.drop("rank"), "negatives")
        bounds = [lower[i] for i in opened]
        for r in found.groupBy("slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(
                F.col("n") == n_negatives).collect():
            bounds[r["slot"]] = r["last"]
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")))
    named = positives.select("anchor", "place", "anchor_id", F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    return ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(
        named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _whole(scores: np.ndarray) -> list[int]:
    return [int(s) for s in scores]
