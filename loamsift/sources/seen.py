"""First-wins rows and the ids seen so far, behind Bloom filters.

Every commit adds three parts at once: the fresh rows, their ids in folders by bucket, and a Bloom
filter of the ids. A filter is a table of 64-bit words, (bucket, word, bits): ``FILTER_BITS`` bits
for each id of the largest bucket, of which an id sets ``PROBES``. A batch looks up the words of its
own ids first; an id that misses one is new for certain. Only the (commit, bucket) folders in which some
id hits all its words are opened, and the ids read there decide, so the filters' false positives cost
a read and never a row.

Ids of ``FAN`` commits of one level are merged into one of the next, filters rebuilt with them, so
folders grow with the logarithm of the history and an id is rewritten once for each level.

Null ids are one id: the first such row is kept. A store has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.ranking import first_per_key
from loamsift.session import stash
from loamsift.sources.committed import CommittedTable, Entry, Part

FILTER_BITS = 10  # bits of a filter for each id: about one id in a hundred hits by chance
PROBES = 7  # bits that an id sets
FAN = 8  # commits of one level that are merged


class SeenStore:
    """Rows kept by the first occurrence of their id, over all commits."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, id_type: str, buckets: int = 256):
        self.table = CommittedTable(spark, path)
        self.spark, self.id_col, self.buckets = spark, id_col, buckets
        self.ids_schema = f"{id_col} {id_type}, bucket int"

    # --- reading ---
    def ids(self) -> DataFrame:
        return self.table.read("ids", self.ids_schema).select(self.id_col)

    def suspects(self, ids: DataFrame) -> DataFrame:
        """(id, bucket, folder): ids that may be in a folder of ids, by the filters."""
        out = None
        touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]
        for bits, folders in sorted(self._filters().items()):
            words = self.table.read("filter", "bucket int, folder string, word int, bits long", folders=folders)
            probes = ids.select(self.id_col, "bucket", F.explode(_probes(self.id_col, bits)).alias("_bit"))
            hit = (probes.withColumn("word", F.shiftright("_bit", 6).cast("int"))
                   .join(words.where(F.col("bucket").isin(touched)), ["bucket", "word"])
                   .where(F.expr("(shiftright(bits, cast(_bit % 64 AS int)) & 1) = 1"))
                   .groupBy(self.id_col, "bucket", "folder").agg(F.count("*").alias("_n"))
                   .where(F.col("_n") == PROBES).drop("_n"))
            out = hit if out is None else out.unionByName(hit)
        return out if out is not None else ids.select(self.id_col, "bucket", F.lit("").alias("folder")).limit(0)

    def _filters(self) -> dict[int, list[str]]:
        """Filter folders by their size in bits, which the folder's column of counts names."""
        out: dict[int, list[str]] = {}
        for e in self.table.listing().of("filter"):
            for bits in e.counts:
                out.setdefault(int(bits), []).append(e.folder)
        return out

    def opened(self, suspects: DataFrame) -> list[tuple[str, int]]:
        """(folder, bucket) pairs that have to be read: at most folders x buckets."""
        return sorted((r["folder"], r["bucket"]) for r in suspects.select(
            "folder", "bucket").distinct().collect())

    def earlier(self, opened: Sequence[tuple[str, int]]) -> DataFrame:
        """The ids of these folders and buckets."""
        by_folder: dict[str, list[str]] = {}
        for folder, bucket in opened:
            by_folder.setdefault(folder, []).append(str(bucket))
        out = None
        for folder, buckets in by_folder.items():
            part = self.table.read("ids", self.ids_schema, "bucket", buckets, [folder])
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.ids_schema) if out is None else out

    def unseen(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose id is not stored; only folders that may hold one are opened."""
        ids = stash(df.select(self.id_col).distinct().withColumn("bucket", self._bucket()), "asked")
        return self._without(df, self.opened(stash(self.suspects(ids), "suspects")))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int")

    def _without(self, df: DataFrame, opened: Sequence[tuple[str, int]]) -> DataFrame:
        if not opened:
            return df
        old = self.earlier(opened).select(F.col(self.id_col).alias("_id"))
        return df.join(old, F.col(self.id_col).eqNullSafe(F.col("_id")), "left_anti")

    # --- writing ---
    def add(self, df: DataFrame, order: Sequence[str | Column], token: str) -> list[tuple[str, int]] | None:
        """Keep the first row of every id that is new; None when ``token`` is committed already.

        Returns the (folder, bucket) pairs of earlier ids that had to be read.
        """
        if token in self.table.listing().tokens:
            return None
        first = stash(first_per_key(df, [self.id_col], order).withColumn("bucket", self._bucket()), "first")
        opened = self.opened(stash(self.suspects(first.select(self.id_col, "bucket")), "suspects"))
        self._commit(token, stash(self._without(first, opened), "fresh") if opened else first)
        self._merge_full_levels()
        return opened

    def _commit(self, token: str, fresh: DataFrame) -> None:
        # the ids' folder is named before it is written, so that the filter can point at it
        folder = CommittedTable.new_folder("ids")
        ids = fresh.select(self.id_col, "bucket")
        self.table.commit(token, rows=Part(fresh.drop("bucket")),
                          ids=Part(ids.repartition("bucket"), "bucket", folder),
                          filter=self._filter(ids, folder))

    def _filter(self, ids: DataFrame, folder: str) -> Part:
        largest = ids.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
        bits = 64
        while bits < FILTER_BITS * largest:
            bits *= 2
        probed = ids.select("bucket", F.explode(_probes(self.id_col, bits)).alias("_bit"))
        words = probed.groupBy("bucket", F.shiftright("_bit", 6).cast("int").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("bits"))
        rows = words.withColumns({"folder": F.lit(folder), "size": F.lit(bits)})
        return Part(rows.repartition("bucket").sortWithinPartitions("bucket", "word"), "size")

    def _merge_full_levels(self) -> None:
        """Merge ids of ``FAN`` commits of a level into one of the next."""
        level = 0
        while True:
            entries = self.table.listing().of("ids")
            own = [e for e in entries if e.level == level]
            if len(own) >= FAN:
                self._merge(own, level + 1)
            if level >= max((e.level for e in entries), default=0):
                return
            level += 1

    def _merge(self, own: list[Entry], level: int) -> None:
        folders = [e.folder for e in own]
        ids = self.table.read("ids", self.ids_schema, folders=folders)
        folder = CommittedTable.new_folder("ids")
        tokens = {t for e in own for t in e.tokens}
        words = [e.folder for e in self.table.listing().of("filter") if tokens & set(e.tokens)]
        self.table.merge({"ids": folders, "filter": words}, {
            "ids": Part(ids.repartition("bucket"), "bucket", folder), "filter": self._filter(ids, folder)}, level)


def _probes(id_col: str, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(id_col)), F.lit(bits)) for i in range(PROBES)])
