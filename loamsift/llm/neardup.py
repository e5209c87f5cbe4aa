"""MinHash near-dedup with tensored banding and exact verification.

Two small collections of ``m`` half keys, each of ``rows`` MinHash values, are made for a
document; table (i, j) has the key made of half i of the first and half j of the second
collection. ``m * m`` tables thus cost ``2 * m * rows`` MinHash values instead of
``2 * rows * m * m``. ``m`` is chosen so that a pair exactly at the threshold misses all tables with
a chance of at most ``MISS``.

Documents with equal shingle sets are one class, found by a 128-bit set hash and its size, so
exact copies never meet each other. In each table bucket every class is compared with the
smallest one (a star, not all pairs); candidates are verified on full shingle sets. Buckets
whose classes then still belong to several components are compared further: one member of
each component with one of the largest, then every pair of classes of different components. In
small buckets these are rows of pairs; the classes of larger ones are dealt into blocks, and two
blocks are compared inside a task, so no row is made for a pair. Every two classes that share a
bucket are thus compared or already in one component. Components are found by alternating
large and small stars until only stars are left; later links join components already found.

A step has as many tasks as its rows need, one for each core at least: most steps hold few rows, and
a task for each shuffle partition would cost more than its work.

Hot groups: minima and counts are combined before the shuffle, joins are ordinary shuffle
joins that Spark may split, and the members of one centre are dealt into salts of about
``MEMBERS`` with a copy of the centre's set each.

Defined cases: null or empty text has no shingles and is linked with nothing; fewer words than
a shingle are one shingle; rows with a null doc_id are linked with nothing and kept (their
component_id is null); rows of one doc_id with different texts are documents of their own;
repeated rows of one doc_id and text share their flags in ``link``, and ``keep_one`` keeps one of
them; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.llm.common import (NOT_SPACE, WordHasher, arrow_map, chunks, mix, seeds, shingles,
                                 text_bytes)
from loamsift.session import stash
from loamsift.sources.positions import PLACE, choose, file_backed, located

ROWS = 3  # MinHash values in a half key
MISS = 4e-4
MEMBERS = 512  # members compared with one copy of a centre's set
SMALL = 12  # classes in a bucket whose pairs are rows; those of larger ones are met in blocks
BLOCK = 512  # classes in a block
BLOCK_SHINGLES = 1 << 19  # shingles in a block, on average, unless one set is larger
COLUMNS = 4096  # shingles counted at a time when two blocks are compared
LINKS = 1 << 18  # links, or rows as narrow, in a task
SHINGLES = 1 << 21  # shingles of the sets in a task, on average


def half_keys(threshold: float) -> int:
    """Half keys in a collection: 2 * (1 - t^rows)^m stays below MISS."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - threshold ** ROWS))


def fitted(df: DataFrame, rows: int, total: float = 0) -> DataFrame:
    """``df`` in no more partitions than at most ``rows`` rows with ``total`` shingles need."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, math.ceil(rows / LINKS), math.ceil(total / SHINGLES)))


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, u, v): set size, set hash and the two half-key collections."""
    n_hashes = 2 * m * ROWS
    factor, shift = seeds(n_hashes, 31) | np.uint64(1), seeds(n_hashes, 32)
    place = seeds(ROWS, 33) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = WordHasher(NOT_SPACE)
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in chunks(texts):
                s, first = shingles(*hasher(texts[lo:hi]), k)
                sets = [np.unique(s[x:y]) for x, y in zip(first[:-1], first[1:])]
                size = np.array([len(x) for x in sets])
                some = np.flatnonzero(size)
                s1, s2 = np.zeros((2, len(sets)), np.uint64)
                halves = np.zeros((len(sets), 2 * m), np.uint64)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    s1[some] = np.add.reduceat(mix(flat), at)
                    s2[some] = np.bitwise_xor.reduceat(mix(flat + np.uint64(1)), at)
                    for h in range(n_hashes):
                        low = np.minimum.reduceat((flat * factor[h] + shift[h]) >> np.uint64(32), at)
                        halves[some, h // ROWS] += (low + np.uint64(1)) * place[h % ROWS]
                halves = mix(halves).view(np.int64)
                ends = np.arange(0, (len(sets) + 1) * m, m, dtype=np.int32)
                yield {"doc_id": b["doc_id"].slice(lo, hi - lo), "n_shingles": size,
                       "s1": s1.view(np.int64), "s2": s2.view(np.int64),
                       "u": pa.ListArray.from_arrays(ends, halves[:, :m].ravel()),
                       "v": pa.ListArray.from_arrays(ends, halves[:, m:].ravel())}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, n_shingles long, s1 long, s2 long, u array<bigint>, "
                     "v array<bigint>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): one row for each table, its key made of a pair of half keys."""
    return (classes.select("rep", F.posexplode("u").alias("i", "x"), "v")
            .select("rep", "i", "x", F.posexplode("v").alias("j", "y"))
            .select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep"))


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int, n: int, total: int) -> DataFrame:
    """(id, words): the sorted distinct shingles of each asked document as bytes.

    ``n`` and ``total`` are the numbers of documents and of their shingles.
    """
    wanted = fitted(docs.select("doc_id", "text").join(
        ids, F.col("doc_id") == F.col("id"), "left_semi"), n, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = WordHasher(NOT_SPACE)
        for b in batches:
            texts = text_bytes(b["text"])
            for lo, hi in chunks(texts):
                s, first = shingles(*hasher(texts[lo:hi]), k)
                yield {"id": b["doc_id"].slice(lo, hi - lo), "words": pa.array(
                    [np.unique(s[x:y]).tobytes() for x, y in zip(first[:-1], first[1:])],
                    pa.binary())}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(wanted, run, f"id {kind}, words binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, mean: float) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|.

    All pairs of one ``a`` share its set; it is copied once for each MEMBERS of them. ``mean`` is
    the mean size of a set. ``pairs`` must be stored.
    """
    rows = 2 * pairs.count()
    kind = pairs.schema["a"].dataType.simpleString()
    sized = fitted(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), rows)
    dealt = fitted(pairs.join(sized, "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), "salts").cast("int")), rows)
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "words")
    centres = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
                           ).join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", "salt", F.lit(None).cast(kind).alias("b"), "words")
    dealt = fitted(members, rows, rows * mean).unionByName(fitted(centres, rows, rows * mean))
    grouped = fitted(dealt.repartition("a", "salt"), rows, rows * mean).sortWithinPartitions(
        "a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        centre = None
        for rows in batches:
            left, right = [], []
            for a, b, words in zip(rows["a"].to_pylist(), rows["b"].to_pylist(),
                                   rows["words"], strict=True):
                own = np.frombuffer(words.as_buffer(), np.uint64)
                if b is None:
                    centre = own.copy()
                    continue
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    left.append(a)
                    right.append(b)
            yield {"a": left, "b": right}
    return arrow_map(grouped, run, f"a {kind}, b {kind}")


def _shape(links: DataFrame, rows: int) -> tuple[int, bool]:
    """The number of links (u, v), at most ``rows``, and whether they are stars: each u has one v, which is no u itself."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = fitted(roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), rows)
    n, other = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, not other


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node reachable.

    ``n`` is the number of edges or more; None: stored edges are counted.
    """
    n = edges.count() if n is None else n
    links = stash(fitted(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n), "links")
    while True:
        n, stars = _shape(links, n)
        if stars:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                fitted(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), n))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = fitted(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n)
        large = fitted(fitted(both.join(low, "u"), 2 * n).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        low = fitted(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        links = stash(fitted(fitted(small, n).unionByName(low.withColumnRenamed("m", "v")).distinct(), n),
                      "links")


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root), whose components are further joined by ``edges`` (a, b)."""
    known = roots.withColumnsRenamed({"node": "_node", "root": "_root"})
    n = edges.count()
    for end in ("a", "b"):
        edges = fitted(edges.join(known, F.col(end) == F.col("_node"), "left").withColumn(
            end, F.coalesce("_root", end)).drop("_node", "_root"), n)
    joined = components(edges, n)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    n = roots.count() + 2 * n
    return stash(fitted(moved.select("node", F.coalesce("top", "root").alias("root")), n).unionByName(
        fitted(joined.join(roots.select("node"), "node", "left_anti"), n)), "roots")


def _open_buckets(members: DataFrame, roots: DataFrame, n_rows: int) -> DataFrame:
    """(key, rep, root, centre, n) of buckets whose classes belong to several components."""
    labelled = fitted(members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("root"), "centre"), n_rows)
    mixed = fitted(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                               F.count("*").alias("n")).where("lo <> hi"), n_rows)
    return fitted(labelled.join(mixed.select("key", "n"), "key"), n_rows)


def _star_pairs(rows: DataFrame, n: int) -> DataFrame:
    """In each open bucket one member of every component against one of the largest component.

    ``n`` is the number of rows or more.
    """
    reps = rows.groupBy("key", "root").agg(
        F.count("*").alias("size"),
        F.min(F.struct(F.xxhash64("rep", "key"), F.col("rep"))).alias("m")
    ).select("key", "root", "size", F.col("m.rep").alias("rep"))
    reps = fitted(reps, n)
    centres = fitted(reps.groupBy("key").agg(F.max(F.struct("size", "root", "rep")).alias("c")), n)
    return reps.join(centres, "key").where(F.col("root") != F.col("c.root")).select(
        F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of classes of different components in open buckets of at most SMALL classes.

    Near copies share many tables, so buckets of the same classes are one.
    """
    few = rows.where(F.col("n") <= SMALL).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rep", "root"))).alias("classes")).select("classes").distinct()
    left = few.select("classes", F.posexplode("classes").alias("at", "x"))
    pairs = left.select("x", F.explode(F.slice("classes", F.col("at") + 2, F.lit(SMALL))).alias("y"))
    return pairs.where(F.col("x.root") != F.col("y.root")).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _blocks(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(rep, root, crowd, band, block) of the classes of ``rows``.

    A crowd holds the classes of buckets that are connected by common classes, a band those whose
    sizes differ by less than the threshold allows: links lie inside a band or between two
    neighbours. Components of half a block or more have blocks of their own.
    """
    n = rows.count()
    crowds = components(rows.select(F.col("rep").alias("a"), F.col("centre").alias("b")), n)
    step = math.log(100 / percent) + 1e-3
    own = stash(fitted(rows.select("rep", "root").distinct().join(sizes, "rep").join(
        crowds.select(F.col("node").alias("rep"), F.col("root").alias("crowd")), "rep").withColumn(
        "band", F.floor(F.log("n_shingles") / step)), n), "crowds")
    big = own.groupBy("crowd", "band", "root").count().where(F.col("count") >= BLOCK // 2)
    parted = fitted(own.join(big, ["crowd", "band", "root"], "left").withColumn(
        "part", F.when(F.col("count").isNull(), F.lit(0)).otherwise(F.xxhash64("root"))), n)
    deals = parted.groupBy("crowd", "band", "part").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("salts"))
    return fitted(parted.join(deals, ["crowd", "band", "part"]).select(
        "rep", "root", "crowd", "band", F.struct(
            "crowd", "band", "part", F.pmod(F.xxhash64("rep"), "salts").alias("salt")).alias("block")), n)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of ``left`` shares with each of ``right``."""
    sides = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*sides)
    at = []
    for sets, flat in zip((left, right), sides):
        owner, place = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.searchsorted(both, flat)
        shared = np.flatnonzero(both[np.minimum(place, len(both) - 1)] == flat) if len(both) else place[:0]
        shared = shared[np.argsort(place[shared], kind="stable")]
        at.append((owner[shared], place[shared]))
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(both), COLUMNS):
        has = []
        for sets, (owner, place) in zip((left, right), at):
            x, y = np.searchsorted(place, (lo, lo + COLUMNS))
            has.append(np.zeros((len(sets), COLUMNS), np.float32))
            has[-1][owner[x:y], place[x:y] - lo] = 1
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def _block_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of all classes within reach of each other's block.

    Of the links between two blocks only those are given that join something new there.
    """
    kind = dealt.schema["rep"].dataType.simpleString()
    blocks = fitted(dealt.groupBy("block", "crowd", "band").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")), dealt.count())
    other = blocks.select("crowd", "band", F.col("block").alias("second"),
                          F.col("lo").alias("lo_2"), F.col("hi").alias("hi_2"))
    one = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("lo_2")) & (F.col("lo") == F.col("hi_2"))
    jobs = stash(blocks.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).join(
        other, ["crowd", "band"]).where((F.col("block") <= F.col("second")) & ~one).select(
        F.col("block").alias("first"), "second"), "jobs")
    rows = dealt.select("rep", "root", "block")
    sides = jobs.withColumn("block", F.col("first")).withColumn("side", F.lit(0)).unionByName(
        jobs.where("first <> second").withColumn("block", F.col("second")).withColumn("side", F.lit(1)))
    tasks = max(dealt.sparkSession.sparkContext.defaultParallelism, jobs.count())  # a job or more each
    grouped = rows.join(sides, "block").select(
        F.xxhash64("first").alias("x"), F.xxhash64("second").alias("y"), "side", "rep", "root").join(
        sets.withColumnRenamed("id", "rep"), "rep").coalesce(2 * tasks).repartition("x", "y").coalesce(
        tasks).sortWithinPartitions("x", "y", "side", "rep")

    def compare(job: list[tuple]) -> dict:
        left = [r for r in job if not r[0]]
        right = [r for r in job if r[0]] or left
        a, b = [[np.frombuffer(r[3], np.uint64) for r in x] for x in (left, right)]
        both, number = _common(a, b), {}
        size_a, size_b = (np.array([len(s) for s in x]) for x in (a, b))
        root_a, root_b = (np.array([number.setdefault(str(r[2]), len(number)) for r in x])
                          for x in (left, right))
        hit = (100 * both >= percent * (size_a[:, None] + size_b - both)) & (root_a[:, None] != root_b)
        i, j = np.nonzero(hit)
        _, some = np.unique(root_a[i] * np.int64(len(number)) + root_b[j], return_index=True)
        up = list(range(len(number)))
        out = {"a": [], "b": []}
        for x, y in zip(i[some].tolist(), j[some].tolist()):
            p, q = int(root_a[x]), int(root_b[y])
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            if p != q:
                up[p] = q
                out["a"].append(left[x][1])
                out["b"].append(right[y][1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        job, now = [], None
        for rows in batches:
            for x, y, side, rep, root, words in zip(*(rows[c].to_pylist() for c in (
                    "x", "y", "side", "rep", "root", "words")), strict=True):
                if (x, y) != now and job:
                    yield compare(job)
                    job = []
                now = x, y
                job.append((side, rep, root, words))
        if job:
            yield compare(job)
    return arrow_map(grouped, run, f"a {kind}, b {kind}")


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id has several rows."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _text_id() -> Column:
    """A doc_id with its text's digest, in the order of doc_id; null for a null doc_id."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", digest.alias("digest")))


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| of their distinct k-word
    shingles. class_id is the smallest doc_id with the same set, component_id the smallest one
    reachable over links; kept marks the documents that are their component's smallest.
    """
    if not _repeats(docs):
        return _link(docs, k, percent)
    plain = [F.col(f"{c}.doc_id").alias(c) for c in ("class_id", "component_id")]
    return _link(docs.select(_text_id().alias("doc_id"), "text"), k, percent, True).select(
        F.col("doc_id.doc_id").alias("doc_id"), "n_shingles", *plain, "kept")


def _link(docs: DataFrame, k: int, percent: int, repeats: bool = False) -> DataFrame:
    """``link`` where all rows of a doc_id have the same text; ``repeats``: it may have several."""
    docs = docs.select("doc_id", "text")
    sigs = stash(signatures(docs, k, half_keys(percent / 100)), "signatures")
    n_docs, total = sigs.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    mean = total / max(n_docs, 1)
    classes = stash(fitted(sigs.where("doc_id is not null and n_shingles > 0").groupBy(
        "n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("u").alias("u"),
                                      F.first("v").alias("v")), n_docs), "classes")
    keys = table_keys(classes)
    centres = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")
                                      ).where("n > 1").select("key", "centre")
    members = stash(fitted(keys.join(centres, "key"), n_docs * half_keys(percent / 100) ** 2), "members")
    n = members.count()
    sets = shingle_sets(docs, members.select(F.col("rep").alias("id")).distinct(), k, n_docs, total)
    sets = stash(fitted(sets.dropDuplicates(["id"]), n_docs, total) if repeats else sets, "sets")
    tested = stash(fitted(members.where("rep <> centre").select(
        F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), n), "tested")
    roots = stash(components(verified(tested, sets, percent, mean), tested.count()), "roots")
    pairs = stash(fitted(_star_pairs(_open_buckets(members, roots, n), n).distinct().join(
        tested, ["a", "b"], "left_anti"), n), "further")
    new = stash(verified(pairs, sets, percent, mean), "edges")
    tested = tested.unionByName(pairs)
    if not new.isEmpty():
        roots = extended(roots, new)
    rows = stash(_open_buckets(members, roots, n), "open")
    pairs = stash(fitted(_all_pairs(rows).distinct().join(tested, ["a", "b"], "left_anti"),
                         rows.count() * SMALL), "further")
    last = [verified(pairs, sets, percent, mean)]
    crowded = rows.where(F.col("n") > SMALL)
    if not crowded.isEmpty():
        sizes = classes.select("rep", "n_shingles")
        last.append(_block_links(stash(_blocks(crowded, sizes, percent), "blocks"), sets, percent))
    new = [stash(part, "edges") for part in last]
    if not all(part.isEmpty() for part in new):
        roots = extended(roots, reduce(DataFrame.unionByName, new))
    ids = classes.select("n_shingles", "s1", "s2", "rep").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "s1", "s2", F.col("rep").alias("class_id"),
        F.coalesce("root", "rep").alias("component_id"))
    own = F.col("doc_id")
    joined = fitted(sigs.select("doc_id", "n_shingles", "s1", "s2").join(
        ids, ["n_shingles", "s1", "s2"], "left"), n_docs)
    alone = own.isNull() | (F.col("n_shingles") == 0)
    return joined.select(
        "doc_id", "n_shingles", F.when(alone, own).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, own).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each linked group, of the document with the smallest doc_id.

    Rows are chosen by their places in the files they come from, so texts are not shuffled for it.
    """
    docs = file_backed(docs)
    if not _repeats(docs):
        gone = _link(docs, k, percent).where("not kept").select("doc_id")
        return choose(docs, located(docs).select("doc_id", *PLACE).join(gone, "doc_id", "left_anti"))
    content = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = located(docs).select(_text_id().alias("doc"), content.alias("content"), *PLACE)
    marks = stash(_link(docs.select(_text_id().alias("doc_id"), "text"), k, percent, True).where(
        "doc_id is not null and n_shingles > 0").select(
        F.col("doc_id").alias("doc"), "kept").distinct(), "marks")
    order = Window.partitionBy("doc").orderBy("content", *PLACE)
    one = rows.join(marks.where("kept"), "doc", "left_semi").withColumn(
        "place", F.row_number().over(order)).where("place = 1").drop("place")
    return choose(docs, rows.join(marks, "doc", "left_anti").unionByName(one))
