"""Merkle fixity audit of WARC replicas.

An archive is a table of records (segment, offset, record): the bytes of one WARC record at a
byte offset of a segment. A replica's tree is built from the bytes alone:

* a leaf is the SHA-256 of one record with its offset and length;
* the first level hashes the leaves of each ordered offset range of ``RANGE`` bytes;
* every further level hashes ``FANOUT`` neighbouring ranges, up to one root a segment.

Every group is bounded by the range or the fan-out, so a segment with a third of all bytes is
hashed by many tasks. Two replicas are compared from the roots down: only children of
mismatching nodes are joined, so the cost of the descent follows the damage, not the archive.

Defined cases: a null record counts as an empty one; null url or html are empty; a null segment or
offset takes no part; repeated records at one offset are hashed together and each is reported once per
digest; an empty replica misses every record; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.session import stash

RANGE = 1 << 18
FANOUT = 16
_EOL = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One uncompressed WARC/1.1 resource record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: resource{_EOL}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">{_EOL}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit(f"{_EOL}Content-Type: text/html{_EOL}Content-Length: "),
        F.length(body).cast("string"), F.lit(_EOL * 2)).cast("binary")
    return F.concat(head, body, F.lit((_EOL * 2).encode()))


def archive(pages: DataFrame, rows_per_segment: int = 256) -> DataFrame:
    """(segment, offset, page_id, record) of pages; a segment holds neighbouring page ids.

    Rows without a page_id are left out.
    """
    made = pages.where(F.col("page_id").isNotNull()).select(
        F.floor(F.col("page_id") / rows_per_segment).alias("segment"), "page_id",
        record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    order = Window.partitionBy("segment").orderBy("page_id", F.xxhash64("record"))
    return made.withColumn("offset", F.sum(F.length("record")).over(order.rowsBetween(
        Window.unboundedPreceding, -1))).select(
        "segment", F.coalesce("offset", F.lit(0)).alias("offset"), "page_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """(segment, offset, length, digest) of each record."""
    record = F.coalesce("record", F.lit(b""))
    return records.where(F.col("segment").isNotNull() & F.col("offset").isNotNull()).select(
        "segment", "offset", F.length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"))


def _node(order: str) -> Column:
    """Hash of a group's children, each with its place, in order."""
    return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(
        ":", F.lpad(F.col(order).cast("string"), 20, "0"), *[
            F.col(c).cast("string") for c in (["length"] if order == "offset" else [])],
        F.col("digest"))))).cast("binary"), 256).alias("digest")


class Tree:
    """The levels of one replica, lowest first, each a written table."""

    def __init__(self, records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT):
        self.range_bytes, self.fanout = range_bytes, fanout
        self.leaves = stash(leaves(records), "leaves")
        first = self.leaves.withColumn("place", F.floor(F.col("offset") / range_bytes))
        level = stash(first.groupBy("segment", "place").agg(_node("offset")), "level")
        self.levels = [level]
        most = level.agg(F.max("place")).first()[0] or 0
        while most > 0:
            level = stash(level.withColumn("up", F.floor(F.col("place") / fanout)).groupBy(
                "segment", "up").agg(_node("place")).withColumnRenamed("up", "place"), "level")
            self.levels.append(level)
            most //= fanout

    def level(self, i: int) -> DataFrame:
        """Level ``i``; above the root the root itself stands for the tree."""
        return self.levels[min(i, len(self.levels) - 1)]


def _mismatches(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    left = a.select(*key, F.col("digest").alias("da"))
    right = b.select(*key, F.col("digest").alias("db"))
    return left.join(right, key, "full").where(~F.col("da").eqNullSafe(F.col("db"))).select(*key)


def audit(original: DataFrame, replica: DataFrame, range_bytes: int = RANGE,
          fanout: int = FANOUT) -> DataFrame:
    """(segment, offset, finding, length, replica_length) of every record that differs.

    ``finding`` is changed, missing (from the replica) or extra (only in the replica).
    """
    a, b = Tree(original, range_bytes, fanout), Tree(replica, range_bytes, fanout)
    top = max(len(a.levels), len(b.levels)) - 1
    bad = stash(_mismatches(a.level(top), b.level(top), ["segment", "place"]), "bad")
    for i in range(top - 1, -1, -1):
        def below(tree: Tree, i: int = i, bad: DataFrame = bad) -> DataFrame:
            children = tree.level(i).withColumn("up", F.floor(F.col("place") / fanout))
            return children.join(bad.withColumnRenamed("place", "up"), ["segment", "up"], "left_semi")
        bad = stash(_mismatches(below(a), below(b), ["segment", "place"]), "bad")

    def inside(tree: Tree) -> DataFrame:
        ranges = tree.leaves.withColumn("place", F.floor(F.col("offset") / range_bytes))
        return ranges.join(bad, ["segment", "place"], "left_semi").drop("place").distinct()
    left = inside(a).select("segment", "offset", F.col("length"), F.col("digest").alias("da"))
    right = inside(b).select("segment", "offset", F.col("length").alias("replica_length"),
                             F.col("digest").alias("db"))
    finding = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise(
        "changed")
    same = left.join(right, ["segment", "offset"], "full").withColumn("finding", finding)
    return same.where(~F.col("da").eqNullSafe(F.col("db"))).select(
        "segment", "offset", "finding", "length", "replica_length")
