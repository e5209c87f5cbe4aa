"""Rows chosen by place: the right ones, without a shuffle of text."""

import pytest
from pyspark.sql import functions as F

from loamsift import session
from loamsift.operators import ranking
from loamsift.plans import collect as collecting
from loamsift.plans import curate as curation
from loamsift.sources import positions
from loamsift.sources.positions import PLACE, choose, file_backed, located


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Files of unequal size with rows of two groups of copies, one of them a third of all."""
    path = str(tmp_path_factory.mktemp("wide") / "t")
    rows = spark.range(12_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("title "), (F.col("id") % 4000).cast("string"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(
            F.concat(F.lit("body "), (F.col("id") % 2000).cast("string"))).alias("body"),
        F.concat(F.lit("l"), (F.col("id") % 2).cast("string")).alias("label"))
    rows.where("row_id < 9000").coalesce(1).write.parquet(path)
    rows.where("row_id >= 9000").repartition(5).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_choose_returns_exactly_the_kept_rows(spark, wide, monkeypatch):
    for condition in ("row_id % 7 = 2", "row_id BETWEEN 4090 AND 4100", "true", "false", "row_id IN (0, 63, 64, 8999)"):
        kept = located(wide).where(condition).select(*PLACE)
        got = choose(wide, kept)
        assert got.columns == wide.columns and ids(got) == ids(wide.where(condition))
    view = wide.where("row_id % 2 = 1").withColumn("title", F.upper("title"))  # places outlast filters
    assert ids(choose(view, located(view).where("row_id > 11000").select(*PLACE))) == list(range(11001, 12000, 2))
    monkeypatch.setattr(positions, "SENT", 2)  # portions of files
    assert ids(choose(wide, located(wide).where("row_id % 7 = 2").select(*PLACE))) == list(range(2, 12_000, 7))


def test_other_sources_are_stored_first(spark, wide):
    assert file_backed(wide) is wide
    made = spark.range(50).withColumnRenamed("id", "row_id").withColumn("t", F.lit("x"))
    stored = file_backed(made)
    assert ids(choose(stored, located(stored).where("row_id > 40").select(*PLACE))) == list(range(41, 50))
    assert ids(file_backed(wide.groupBy("row_id").count())) == list(range(12_000))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_text(df):
    """Whether an Exchange stands above a column of text: its output attributes are in its child's."""
    def under(node):
        found = False
        children = node.children()
        for i in range(children.size()):
            found |= under(children.apply(i))
        if node.nodeName() == "Exchange":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            found |= bool({"title", "body", "text"} & set(names))
        return found
    return under(df._jdf.queryExecution().sparkPlan()) or any(
        "body#" in x for x in plan_of(df).splitlines() if "Exchange hashpartitioning" in x)


def test_no_exchange_below_text_with_broadcast_off(spark, wide):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frames = {
            "D01": ranking.dedup_title_body(wide), "D02": ranking.dedup_title_then_body(wide),
            "W01": ranking.cap_per_label(wide, 100, ("l0", "l1"), F.length("body")),
            "finish": curation.finish(wide.withColumn("repo", F.lit("r")), located(wide).select(*PLACE),
                                      curation.FINAL)}
        for name, df in frames.items():
            plan = plan_of(df)
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name
            assert "Exchange hashpartitioning" not in plan, name  # the scan side is filtered where it is read
            assert not shuffles_text(df), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_dedups_keep_the_first_rows(spark, wide):
    rows = [r.asDict() for r in wide.orderBy("row_id").collect()]

    def first(rows, *keys):
        seen, out = set(), []
        for r in rows:
            k = tuple(r[x] for x in keys)
            if k not in seen:
                seen.add(k)
                out.append(r)
        return out
    assert ids(ranking.dedup_title_body(wide)) == [r["row_id"] for r in first(rows, "title", "body")]
    want = first(first(rows, "title", "label"), "body", "label")
    assert ids(ranking.dedup_title_then_body(wide)) == [r["row_id"] for r in want]


def test_spread_only_where_cores_would_idle(spark, wide, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(str(tmp_path / "one")) if wide.coalesce(1).write.parquet(str(tmp_path / "one")) else \
        spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(one).rdd.getNumPartitions() == cores and ids(session.spread(one)) == ids(wide)
    wide.repartition(3 * cores).write.parquet(str(tmp_path / "many"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many) is many
    spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_collect_reads_the_newest_text_once(spark):
    """Texts are picked by place after narrow rows are ranked."""
    rows = [(i % 30, "r0", f"Crash {i // 30} while saving the project {i % 30}",
             f"The application stops with an error when saving number {i}. " * 8, i) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, repo string, title string, body string, at long").select(
        "*", F.lit("closed").alias("state"), F.lit(3).alias("comments"), F.lit("user").alias("login"),
        F.lit("User").alias("user_type"), F.lit(False).alias("is_pr"), F.array(F.lit("bug")).alias("labels"),
        F.timestamp_seconds("at").alias("updated_at")).drop("at")
    from loamsift.operators import discovery
    repos = spark.createDataFrame([("r0", 10, 1000)], "full_name string, stars long, issues long")
    none = spark.createDataFrame([], "id long"), spark.createDataFrame([], "label string, repo string")
    zero = spark.createDataFrame([("bug", 0)], "label string, have long")
    aliases = discovery.alias_dim(spark).where("label = 'bug'")
    got = collecting.collect(df, repos, aliases, *none, zero, n_repos=1, target=50).rows.collect()
    assert len(got) == 30 and all(r["title"].startswith("Crash 2 ") for r in got)
