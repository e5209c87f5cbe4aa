"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Every document is a point of metadata: bytes, bytes per character, lines, checksum of the text. A node that is to hold several leaves is split along its widest dimension, measured
against the whole table, at the weighted median for its leaves on either side; splitting goes
on until each leaf is one shard. Weighted medians are found for all nodes of a level together:
a histogram of ``BINS`` bins a node is summed map-side and brought to the driver, and the bin
that holds the median is refined. Equal values go on to the text checksum, so copies stay
together, and only a group of copies that would unbalance a cut by more than ``GROUP_SLACK``
is split by a hash of doc_id: a group with a third of all rows is thus spread over as many
shards as it fills.

What reaches the driver is bounded by ``BINS`` times the number of shards. The narrow points
are written once; texts are read once.

Defined cases: null text has no bytes and the checksum of an empty text; repeated rows are placed one by one; null doc_id hashes like a value; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.session import stash

BINS = 1024
TOLERANCE = 0.002  # of a shard: a cut this near to the median is not refined
GROUP_SLACK = 0.02  # of a shard: a cut beside a group of copies may be this far off
SLOT_ROWS = 20_000  # rows numbered by one window group, about
DIMENSIONS = ("c0", "c1", "c2", "c3")
_HASH_BITS = 62


def points(docs: DataFrame, overhead: int) -> DataFrame:
    """(doc_id, size, text_crc32, c0..c3, h): a row's weight, its coordinates and a tie-breaker."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + overhead).cast("long")
    wide = F.floor(F.octet_length(text) * 1000 / F.greatest(F.length(text), F.lit(1)))
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        size.alias("c0"), wide.cast("long").alias("c1"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("c2"),
        F.crc32(text.cast("binary")).alias("c3"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _HASH_BITS).alias("h"))


class Node:
    """A tree node for ``leaves`` shards; once cut, it has a dimension, a threshold and two children."""

    def __init__(self, name: int, leaves: int):
        self.name, self.leaves = name, leaves
        self.cut: tuple[int, int, int] | None = None
        self.children: tuple[Node, Node] | None = None

    def begin(self, dim: int, low: int, high: int, weight: int) -> None:
        self.dim, self.stage, self.fixed = dim, 0, [0, 0]
        self.low, self.high, self.base = low, high, 0
        self.goal = weight * (self.leaves // 2) / self.leaves
        self.leaf = weight / self.leaves

    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)

    def refine(self, bins: list) -> None:
        """Take the bin with the median; cut beside it when near enough, else look into it."""
        before = self.base
        for b in sorted(bins, key=lambda b: b["bin"]):
            if before + b["w"] >= self.goal:
                break
            before += b["w"]
        under, over = self.goal - before, before + b["w"] - self.goal
        pinned = b["least"] == b["most"]
        copies = pinned and (self.stage == 1 or self.dim == len(DIMENSIONS) - 1)
        slack = (GROUP_SLACK if copies else TOLERANCE) * self.leaf
        if min(under, over) <= slack or b["n"] == 1 or (pinned and self.stage == 2):
            value = b["least"] if under <= over else b["most"] + 1
            self.cut = tuple([*self.fixed[:self.stage], value, 0, 0][:3])
        elif not pinned:
            self.low, self.high, self.base = b["least"], b["most"], before
        else:
            self.fixed[self.stage] = b["least"]
            self.stage += 1
            self.low, self.base = 0, before
            self.high = (1 << (32 if self.stage == 1 else _HASH_BITS)) - 1

    def left_of(self) -> Column:
        v, c, h = F.col(DIMENSIONS[self.dim]), F.col("c3"), F.col("h")
        t0, t1, t2 = (F.lit(t).cast("long") for t in self.cut)
        return (v < t0) | ((v == t0) & ((c < t1) | ((c == t1) & (h < t2))))


def _place(node: Node, number) -> Column:
    """The node, or the number of the leaf, that a row falls into."""
    if node.children is None:
        return F.lit(number(node)).cast("int")
    left, right = node.children
    return F.when(node.left_of(), _place(left, number)).otherwise(_place(right, number))


def _histograms(rows: DataFrame, root: Node, nodes: list[Node]) -> dict[int, list]:
    """Weight, rows and extremes of each bin of each node; one narrow pass for all of them."""
    state = ", ".join(
        f"({n.name}, {n.dim}, {n.stage}, {n.fixed[0]}L, {n.fixed[1]}L, {n.low}L, {n.high}L, "
        f"{n.width()}L)" for n in nodes)
    # a row for each open node, fewer than the shards
    table = F.broadcast(rows.sparkSession.sql(
        f"SELECT * FROM VALUES {state} AS t(node, dim, stage, e0, e1, low, high, width)"))
    joined = rows.withColumn("node", _place(root, lambda n: n.name)).join(table, "node")
    value = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
    key = F.when(F.col("stage") == 0, value).when(F.col("stage") == 1, F.col("c3")).otherwise(
        F.col("h"))
    inside = (((F.col("stage") == 0) | (value == F.col("e0")))
              & ((F.col("stage") < 2) | (F.col("c3") == F.col("e1")))
              & key.between(F.col("low"), F.col("high")))
    bins = joined.where(inside).select("node", "size", key.alias("key"), "low", "width").selectExpr(
        "node", "size", "key", "(key - low) div width AS bin")
    out: dict[int, list] = {n.name: [] for n in nodes}
    for r in bins.groupBy("node", "bin").agg(
            F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("least"),
            F.max("key").alias("most")).collect():  # at most BINS rows a node
        out[r["node"]].append(r)
    return out


def build_tree(rows: DataFrame, leaves: int) -> tuple[Node, int]:
    """The tree with ``leaves`` leaves and the number of rows."""
    root, names = Node(0, leaves), 1
    spans, level, n_rows = None, [root], 0
    while level:
        stats = rows.withColumn("node", _place(root, lambda n: n.name)).where(
            F.col("node").isin([n.name for n in level])).groupBy("node").agg(
            F.count("*").alias("n"), F.sum("size").alias("w"),
            *[f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)])
        found = {r["node"]: r for r in stats.collect()}  # a row for each open node
        if spans is None:
            if not found:
                return root, 0
            n_rows = found[0]["n"]
            spans = [max(1, found[0][f"max_{c}"] - found[0][f"min_{c}"]) for c in DIMENSIONS]
        for n in level:
            if n.name not in found:  # no rows: all leaves below stay empty
                n.begin(0, 0, 0, 0)
                n.cut = (0, 0, 0)
                continue
            r = found[n.name]
            wide = [(r[f"max_{c}"] - r[f"min_{c}"]) / s for c, s in zip(DIMENSIONS, spans)]
            dim = wide.index(max(wide))
            n.begin(dim, r[f"min_{DIMENSIONS[dim]}"], r[f"max_{DIMENSIONS[dim]}"], r["w"])
        while waiting := [n for n in level if n.cut is None]:
            bins = _histograms(rows, root, waiting)
            for n in waiting:
                n.refine(bins[n.name])
        for n in level:
            half = n.leaves // 2
            n.children = (Node(names, half), Node(names + 1, n.leaves - half))
            names += 2
        level = [c for n in level for c in n.children if c.leaves > 1]
    return root, n_rows


def _leaves(node: Node) -> list[Node]:
    return [node] if node.children is None else [
        x for c in node.children for x in _leaves(c)]


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
          overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes, slots from 0.

    The number of shards is given, or follows from ``target_bytes``. ``overhead`` bytes are
    added to each document's size.
    """
    rows = stash(points(docs, overhead), "points")
    if n_shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    if n_shards > 1:
        root, n_rows = build_tree(rows, n_shards)
    else:
        root, n_rows = Node(0, 1), rows.count()
    order = {n.name: i for i, n in enumerate(_leaves(root))}
    groups = max(1, -(-n_rows // (n_shards * SLOT_ROWS)))
    step = (1 << _HASH_BITS) // groups + 1
    placed = rows.withColumn("shard", _place(root, lambda n: order[n.name])).withColumn(
        "part", F.expr(f"h div {step}L").cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "part").orderBy("h", "doc_id", "text_crc32", "size")
    return placed.withColumn("r", F.row_number().over(within) - 1).join(
        before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("r")).alias("slot"))
