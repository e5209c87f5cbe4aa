"""Tables that grow by commits: repeats, crashes, races, merges and pruned reads."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from loamsift.operators import summary
from loamsift.sources import committed, readers, writers
from loamsift.sources.committed import CommittedTable, Part


class Killed(Exception):
    pass


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def pairs(spark, *names):
    return spark.createDataFrame([(n, "r") for n in names], "label string, repo string")


def test_commits_add_up_and_repeats_do_not(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert [df.count() for df in readers.read_state(spark, path)] == [0, 0]
    assert writers.save_state(path, spark.range(3), pairs(spark, "a"), "run1")
    assert not writers.save_state(path, spark.range(30), pairs(spark, "b"), "run1")
    assert writers.save_state(path, spark.range(3, 5), pairs(spark), "run2")
    seen, done = readers.read_state(spark, path)
    assert ids(seen) == [0, 1, 2, 3, 4] and [tuple(r) for r in done.collect()] == [("a", "r")]


@pytest.mark.parametrize("at", ["first part", "second part", "publish"])
def test_killed_and_repeated_save_leaves_one_copy(spark, tmp_path, monkeypatch, at):
    path = f"{tmp_path}/s"
    writers.save_state(path, spark.range(2), pairs(spark, "a"), "run1")
    write, calls = CommittedTable._write, []

    def dies(self, *args):
        calls.append(args[0])
        entry = write(self, *args)
        if len(calls) == ("first part", "second part").index(at) + 1:
            raise Killed
        return entry
    with monkeypatch.context() as m:
        if at == "publish":
            m.setattr(CommittedTable, "_publish", lambda self, new: (_ for _ in ()).throw(Killed()))
        else:
            m.setattr(CommittedTable, "_write", dies)
        with pytest.raises(Killed):
            writers.save_state(path, spark.range(2, 6), pairs(spark, "b"), "run2")
    seen, done = readers.read_state(spark, path)
    assert ids(seen) == [0, 1] and done.count() == 1  # neither part of the killed run counts
    assert writers.save_state(path, spark.range(2, 6), pairs(spark, "b"), "run2")
    seen, done = readers.read_state(spark, path)
    assert ids(seen) == [0, 1, 2, 3, 4, 5] and done.count() == 2
    table = CommittedTable(spark, path)
    assert table.vacuum() == [] and len(table.vacuum(older_than_s=-60)) >= 1
    assert ids(readers.read_state(spark, path)[0]) == [0, 1, 2, 3, 4, 5]


def test_of_two_writers_the_slower_starts_over(spark, tmp_path, monkeypatch):
    table, other = (CommittedTable(spark, f"{tmp_path}/t") for _ in range(2))
    table.commit("a", x=spark.range(2))
    publish, raced = CommittedTable._publish, []

    def late(self, new):
        if not raced:  # while "c" is on its way, "b" takes the number it wanted
            raced.append(True)
            other.commit("b", x=spark.range(5, 7))
        return publish(self, new)
    monkeypatch.setattr(CommittedTable, "_publish", late)
    assert table.commit("c", x=spark.range(8, 9))
    listing = table.listing()
    assert listing.version == 3 and listing.tokens == ["a", "b", "c"]
    assert ids(table.read("x", "id long")) == [0, 1, 5, 6, 8]


def test_merge_replaces_folders_or_gives_way(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    for i in range(3):
        table.commit(f"c{i}", x=spark.range(i * 10, i * 10 + 2))
    folders = [e.folder for e in table.listing().of("x")]
    merged = Part(table.read("x", "id long", folders=folders[:2]).coalesce(1))
    assert table.merge({"x": folders[:2]}, {"x": merged}, 1)
    assert not table.merge({"x": folders[:2]}, {"x": merged}, 1)  # gone already
    assert sorted(e.level for e in table.listing().of("x")) == [0, 1]
    assert ids(table.read("x", "id long")) == [0, 1, 10, 11, 20, 21]
    assert not table.commit("c1", x=spark.range(99))  # tokens outlive their folders
    with pytest.raises(ValueError, match="merged"):
        table.commit("c1", replace=True, x=spark.range(99))


def log_rows(spark, days, per_day):
    return spark.range(days * per_day).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % days) * 86_400 + F.col("id")).alias("ts"),
        F.lit("bug").alias("label"), (F.col("id") % 7).cast("double").alias("confidence"),
        F.lit("single").alias("source"), F.concat(F.lit("u"), F.col("id") % 3).alias("user"))


def test_timeline_opens_only_the_newest_days(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = log_rows(spark, 40, 50)
    for part in range(3):
        writers.append_log(rows.where(F.col("confidence") % 3 == part), path, f"b{part}")
    days = readers.newest_days(spark, path, 120)
    assert len(days) == 3  # 50 rows a day
    newest = readers.read_newest(spark, path, 120)
    opened = {f.split("day=")[1][:10] for f in newest.inputFiles()}
    assert opened == set(days) and newest.count() == 150
    got = summary.timeline(newest, 120).collect()
    assert got == summary.timeline(rows, 120).collect() and len(got) == 120


def test_timeline_keeps_ties_and_rows_without_time(spark, tmp_path):
    path = f"{tmp_path}/log"
    one = datetime.datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame(
        [(one, f"l{i % 5}", float(i), "s", "u") for i in range(9)] + [(None, "x", 1.0, "s", "u")] * 3
        + [(datetime.datetime(2023, 1, 1), "old", 2.0, "s", "u")],
        "ts timestamp, label string, confidence double, source string, user string")
    writers.append_log(rows, path, "a")
    for n in (1, 5, 9, 10, 12, 13, 50):
        got = summary.timeline(readers.read_newest(spark, path, n), n).collect()
        assert got == summary.timeline(rows, n).collect() and len(got) == min(n, 13)
    assert readers.newest_days(spark, path, 9) == ["2024-05-01"]
    assert readers.newest_days(spark, path, 11) == ["2024-05-01", "2023-01-01", ""]
    assert readers.read_newest(spark, f"{tmp_path}/none", 5).count() == 0


def test_replaced_commit(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = log_rows(spark, 2, 5)
    assert writers.append_log(rows, path, "a") and not writers.append_log(rows, path, "a")
    assert writers.append_log(rows.limit(3), path, "a", replace=True)
    assert readers.read_log(spark, path).count() == 3
    assert writers.append_log(rows.limit(0), path, "a", replace=True)
    assert readers.read_log(spark, path).count() == 0
    assert os.path.isdir(f"{path}/_lists") and committed.ALL == "*"


def test_log_view_from_sums_equals_the_scan(spark, tmp_path):
    from loamsift.plans import score as scoreplan
    path = f"{tmp_path}/log"
    rows = log_rows(spark, 9, 60).withColumn("label", F.concat(F.lit("l"), F.col("confidence").cast("int"))).withColumn(
        "source", F.when(F.col("user") == "u1", "batch").otherwise("single")).withColumn(
        "confidence", F.when(F.col("user") == "u2", None).otherwise(F.col("confidence")))
    for i in range(3):
        writers.append_log(rows.where(F.pmod(F.unix_timestamp("ts"), F.lit(3)) == i), path, f"c{i}")
    writers.append_log(rows.limit(5), path, "c1")  # a repeat
    got, want = scoreplan.analytics_of_log(spark, path), scoreplan.analytics(rows)
    for name in ("labels", "sources", "timeline"):
        assert sorted(map(tuple, got[name].collect()), key=repr) == sorted(map(tuple, want[name].collect()), key=repr)
    opened = {f.split("/")[-2].split("=")[0] for f in got["labels"].inputFiles()}
    assert opened == {"commit"}  # sums only, no folder of a day
    empty = scoreplan.analytics_of_log(spark, f"{tmp_path}/none")
    assert empty["labels"].count() == 0 and tuple(empty["sources"].first()) == (0, 0, 0)
