"""The store of seen ids: first wins, filters spare reads, merges keep everything."""

import pytest
from pyspark.sql import functions as F

from loamsift.sources import seen
from loamsift.sources.seen import SeenStore

SCHEMA = "id long, n long, text string"


def batch(spark, rows):
    return spark.createDataFrame([(i, n, f"t{n}") for i, n in rows], SCHEMA)


def kept(store):
    return sorted((r["id"] is None, r["id"] or 0, r["n"]) for r in store.table.read("rows", SCHEMA).collect())


def test_first_row_of_every_id_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FAN", 3)
    store = SeenStore(spark, f"{tmp_path}/s", "id", "long", buckets=8)
    first, n = {}, 0
    for b in range(11):
        rows = [(i, n := n + 1) for i in range(b * 40, b * 40 + 60)]  # a third came before
        rows += [(b * 40, n := n + 1), (None, n := n + 1), (7, n := n + 1)]
        for i, m in rows:
            first.setdefault(i, m)
        assert store.add(batch(spark, rows), ["n"], f"b{b}") is not None
    want = sorted((i is None, i or 0, m) for i, m in first.items())
    assert kept(store) == want
    assert store.add(batch(spark, [(10_000, 1)]), ["n"], "b3") is None  # a replay adds nothing
    assert kept(store) == want
    assert store.ids().count() == store.ids().distinct().count() == len(first)
    levels = [e.level for e in store.table.listing().of("ids")]
    assert len(levels) <= 2 * 3 and max(levels) == 2  # 11 commits, merged by threes
    assert len(store.table.listing().of("filter")) == len(levels)


def test_new_ids_open_few_folders(spark, tmp_path):
    """Twenty batches of new ids with a few old ones: each reads a small part of the history."""
    store = SeenStore(spark, f"{tmp_path}/s", "id", "long", buckets=32)
    history = spark.range(40_000).select("id", F.col("id").alias("n"), F.lit("x").alias("text"))
    assert store.add(history, ["n"], "history") == []
    for b in range(20):
        lo = 40_000 + b * 50
        rows = spark.range(lo, lo + 50).unionByName(spark.range(b * 100, b * 100 + 2)).select(
            "id", F.col("id").alias("n"), F.lit("x").alias("text"))
        before = {e.folder: e.counts for e in store.table.listing().of("ids")}
        opened = store.add(rows, ["n"], f"b{b}")
        read = sum(before[folder][str(bucket)] for folder, bucket in opened)
        total = sum(sum(counts.values()) for counts in before.values())
        assert 1 <= len({k for _, k in opened}) and read < total / 3  # two old ids, some false positives
    assert store.ids().count() == 41_000 and kept(store)[0] == (False, 0, 0)
    asked = spark.range(40_990, 41_010).select("id", F.lit("y").alias("t"))
    left = store.unseen(asked.unionByName(asked))  # repeats are rows
    assert sorted(r["id"] for r in left.collect()) == sorted(2 * list(range(41_000, 41_010)))


def test_filters_have_few_false_positives_and_no_misses(spark, tmp_path):
    store = SeenStore(spark, f"{tmp_path}/s", "id", "long", buckets=4)
    rows = spark.range(20_000).select("id", F.col("id").alias("n"), F.lit("x").alias("text"))
    store.add(rows, ["n"], "a")

    def hits(ids):
        return store.suspects(ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))).count()
    assert hits(spark.range(20_000)) == 20_000
    assert hits(spark.range(10 ** 6, 10 ** 6 + 20_000)) < 400  # two in a hundred at most


def test_empty_batches_and_text_ids(spark, tmp_path):
    store = SeenStore(spark, f"{tmp_path}/s", "id", "string", buckets=4)
    schema = "id string, n int"
    assert store.add(spark.createDataFrame([], schema), ["n"], "a") == []
    assert store.add(spark.createDataFrame([("x", 2), ("x", 1), ("é", 3)], schema), ["n"], "b") == []
    assert len(store.add(spark.createDataFrame([("x", 0), ("y", 5)], schema), ["n"], "c")) >= 1
    assert store.add(spark.createDataFrame([], schema), ["n"], "d") == []
    rows = {(r["id"], r["n"]) for r in store.table.read("rows", schema).collect()}
    assert rows == {("x", 1), ("é", 3), ("y", 5)}


def test_killed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    store = SeenStore(spark, f"{tmp_path}/s", "id", "long", buckets=4)
    store.add(batch(spark, [(1, 1)]), ["n"], "a")
    with monkeypatch.context() as m:
        m.setattr(type(store.table), "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.add(batch(spark, [(1, 2), (2, 2)]), ["n"], "b")
    assert store.ids().count() == 1
    store.add(batch(spark, [(1, 2), (2, 2)]), ["n"], "b")
    assert kept(store) == [(False, 1, 1), (False, 2, 2)]
