import pytest
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.operators import summary
from loamsift.plans import collect as collecting
from loamsift.plans import curate as curation
from loamsift.sources.positions import file_backed
from suite import views
from tests import samples
from tests.conftest import SF_DIR


def brute_curate(rows, recipe):
    """The curation flow on a small list, step by step."""
    final = recipe.name == "final"
    import re
    from suite import duck
    bot, spam = re.compile(duck.BOT_MENTION), re.compile(duck.SPAM)
    stages = [len(rows)]
    rows = [dict(r, label=r["label"].strip().lower()) for r in rows]
    rows = [r for r in rows if r["label"] in recipe.labels]
    stages.append(len(rows))
    if final:
        rows = [r for r in rows if not bot.search(r["title"]) and not bot.search(r["body"])]
    else:
        rows = [r for r in rows if not spam.search(r["body"][:500])]
    stages.append(len(rows))
    for r in rows:
        r["title"] = samples.clean(r["title"], f"title_{recipe.name}")
        r["body"] = samples.clean(r["body"], f"body_{recipe.name}")
    rows = [r for r in rows if len(r["title"].split()) >= recipe.min_title_words
            and len(r["body"].split()) >= recipe.min_body_words]
    stages.append(len(rows))
    args = (400, 4, fixed.STOP_WORDS_FINAL, False) if final else (500, 0, fixed.STOP_WORDS_V3, True)
    rows = [r for r in rows if samples.english(r["title"], r["body"], *args)]
    stages.append(len(rows))

    def first(rows, *keys):
        seen, out = set(), []
        for r in sorted(rows, key=lambda r: r["row_id"]):
            k = tuple(r[x] for x in keys)
            if k not in seen:
                seen.add(k)
                out.append(r)
        return out
    rows = first(first(rows, "title", "label"), "body", "label") if final else first(
        rows, "title", "body")
    stages.append(len(rows))
    kept = []
    for label in recipe.labels:
        part = sorted((r for r in rows if r["label"] == label),
                      key=lambda r: (-len(r["body"].split()), r["row_id"]))
        kept += part[:recipe.cap]
    stages.append(len(kept))
    kept = [r for r in kept if not final or r["repo"].strip()]
    stages.append(len(kept))
    return {(r["row_id"], r["repo"], r["title"], r["body"], r["label"]) for r in kept}, stages


@pytest.fixture(scope="module")
def raw(spark):
    """Given rows plus a hot group of copies and rows without a repo."""
    df = views.issues(spark, SF_DIR).select("row_id", "repo", "title", "body", "label")
    copies = df.where("row_id = 9").select(
        F.explode(F.expr("sequence(1000L, 1149L)")).alias("row_id"), "repo", "title", "body", F.lit("question").alias("label"))
    blank = df.limit(20).withColumn("row_id", F.col("row_id") + 5000).withColumn(
        "repo", F.lit(" ")).withColumn("title", F.concat("title", F.lit(" again indeed")))
    return df.unionByName(copies).unionByName(blank)


@pytest.mark.parametrize("recipe", [curation.V3, curation.FINAL,
                                    curation.V3._replace(cap=5), curation.FINAL._replace(cap=3)])
def test_curation_equals_brute_force(spark, raw, recipe):
    want, stages = brute_curate([r.asDict() for r in raw.collect()], recipe)
    got = {tuple(r) for r in curation.curate(raw, recipe).collect()}
    assert got == want
    shuffled = raw.repartition(11, F.rand(3))
    assert {tuple(r) for r in curation.curate(shuffled, recipe).collect()} == want
    run = curation.Curation(raw, recipe)
    funnel = run.funnel().orderBy("stage_no").collect()
    assert [r["n"] for r in funnel] == stages
    assert {tuple(r) for r in run.result().collect()} == want
    removed = summary.removed_per_stage(run.funnel()).agg(F.sum("removed")).first()[0]
    assert removed == stages[0] - stages[-1]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_runs_once_per_scan(spark):
    df = file_backed(views.issues(spark, SF_DIR))
    v = curation.verdicts(df, curation.V3).where(F.col("dropped_at").isNull())
    optimized = v._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("java_method") == 2  # one NFKC for the title, one for the body


def test_curation_ranks_narrow_rows_and_cleans_twice(spark):
    run = curation.Curation(views.issues(spark, SF_DIR), curation.FINAL)
    plan = plan_text(curation.balanced(curation.survivors(
        curation.verdicts(run.raw, run.recipe), run.recipe), run.recipe))
    assert plan.count("WindowGroupLimit") == 8  # two dedups and two ranking levels, map and reduce
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert wide and all("body#" not in line and "text#" not in line for line in wide)
    for df in (run.result(), curation.curate(run.raw, curation.V3)):
        stored = plan_text(df)  # the result is stored before it is ordered
        assert "java_method" not in stored and stored.count("FileScan") == 1


def test_uncapped_recipe_keeps_all_unique_rows(spark, raw):
    everything = curation.FINAL._replace(cap=None)
    want, _ = brute_curate([r.asDict() for r in raw.collect()], curation.FINAL._replace(cap=10**9))
    assert {tuple(r) for r in curation.curate(raw, everything).collect()} == want


def test_scan_is_pruned_and_filter_pushed(spark):
    df = views.issues(spark, SF_DIR).where("id > 10").select("id", "repo")
    plan = plan_text(df)
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    assert "GreaterThan(doc_id,10)" in plan


def test_discovery_has_no_nested_loop_join(spark):
    from loamsift.operators import discovery
    df = collecting.choose_repos(views.repos(spark, SF_DIR), discovery.spec_dim(spark))
    plan = plan_text(df)
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_report_lists_every_block(spark, raw):
    report = curation.Curation(raw, curation.FINAL).report().collect()
    assert {r["section"] for r in report} == {
        "1 stages", "2 retention", "3 classes", "4 balance", "5 words", "6 leak", "7 cells"}
    assert next(r["value"] for r in report if r["metric"] == "placeholders") == "0"


def test_collect_resumes_without_repeats(spark):
    from loamsift.operators import discovery
    df = views.issues(spark, SF_DIR).drop("label").withColumn(
        "labels", F.array("alias1", "alias2")).withColumn("updated_at", F.timestamp_seconds("id"))
    repos = df.groupBy(F.col("repo").alias("full_name")).agg(
        F.count("*").alias("stars"), (F.count("*") * 2).alias("issues"))
    aliases, labels = discovery.alias_dim(spark), discovery.label_dim(spark)
    none = spark.createDataFrame([], "id long")
    done = spark.createDataFrame([], "label string, repo string")
    have = labels.select("label", F.lit(0).cast("long").alias("have"))
    first = collecting.collect(df, repos, aliases, none, done, have, n_repos=100, target=3)
    rows = first.rows.collect()
    assert rows and len({r["id"] for r in rows}) == len(rows)
    assert len(rows) == first.seen.where("reason IS NULL").count() <= first.seen.count()
    # ids that passed but were not taken stay open; finished pairs and emitted ids do not come again
    again = collecting.collect(df, repos, aliases, first.seen, first.done, have, n_repos=100,
                               target=3).rows.collect()
    assert not {r["id"] for r in again} & {r["id"] for r in rows}
    pairs = {(r["label"], r["repo"]) for r in first.done.collect()}
    assert not {(r["label"], r["repo"]) for r in again} & pairs
    assert first.done.count() <= first.seen.count()
    full = labels.select("label", F.when(F.col("label") == "bug", 3).otherwise(0).cast("long")
                         .alias("have"))
    rest = collecting.collect(df, repos, aliases, none, done, full, n_repos=100, target=3)
    assert rest.rows.where("label = 'bug'").count() == 0 and rest.rows.count() > 0
    gap = {r["label"]: r["needed"] for r in collecting.coverage(first.rows, labels, 3).collect()}
    assert all(v >= 0 for v in gap.values()) and len(gap) == 6


def test_collect_loses_nothing_between_runs(spark):
    """Three repos of forty good issues: a small target first, then a large one, is everything."""
    from loamsift.operators import discovery
    rows = [(i, f"r{i % 3}", f"Crash while saving the project {i} again",
             f"The application stops with an error when saving the project number {i}. " * 8)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, repo string, title string, body string").select(
        "*", F.lit("closed").alias("state"), F.lit(3).alias("comments"), F.lit("user").alias("login"),
        F.lit("User").alias("user_type"), F.lit(False).alias("is_pr"),
        F.array(F.lit("bug"), F.lit("docs")).alias("labels"),
        F.timestamp_seconds("id").alias("updated_at"))
    repos = spark.createDataFrame([(f"r{i}", 10 - i, 1000) for i in range(3)],
                                  "full_name string, stars long, issues long")
    aliases = discovery.alias_dim(spark).where("label = 'bug'")
    seen = spark.createDataFrame([], "id long")
    done = spark.createDataFrame([], "label string, repo string")
    zero = spark.createDataFrame([("bug", 0)], "label string, have long")
    first = collecting.collect(df, repos, aliases, seen, done, zero, n_repos=2, target=25)
    assert first.rows.count() == 40 and first.seen.count() == 40 and first.done.count() == 1
    have = spark.createDataFrame([("bug", 40)], "label string, have long")
    second = collecting.collect(df, repos, aliases, first.seen, first.done, have, n_repos=2,
                                target=1000)
    ids = {r["id"] for r in first.rows.unionByName(second.rows).collect()}
    assert len(ids) == 120
    both = discovery.alias_dim(spark)  # what the first label leaves over goes to the second
    shared = collecting.collect(df, repos, both, seen, done, zero, n_repos=2, target=25)
    counts = {r["label"]: r["count"] for r in shared.rows.groupBy("label").count().collect()}
    assert counts["bug"] == 40 and counts.get("documentation") == 40


def test_report_is_not_cut(spark, tmp_path):
    from loamsift.sources import writers
    rows = [("3 classes", 1, "a label with a name of more than thirty characters", "1,234,567 (12.3%)")]
    writers.write_report(spark.createDataFrame(rows, "section string, line int, metric string, value string"),
                         str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).first()["value"]
    assert "1,234,567 (12.3%)" in text and rows[0][2] in text
