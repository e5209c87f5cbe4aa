import random

import pytest
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.operators import discovery, gates, ranking, summary


def hot_rows(n=4000, seed=1):
    """A third of the rows share one key."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 400)}", rng.randint(0, 30))
            for i in range(n)]


def test_first_per_key_with_a_hot_key(spark):
    rows = hot_rows()
    want = {}
    for i, k, _ in rows:
        want.setdefault(k, i)
    df = spark.createDataFrame(rows, "row_id int, k string, v int").repartition(13)
    got = {r["k"]: r["row_id"] for r in ranking.first_per_key(df, ["k"], ["row_id"]).collect()}
    assert got == want


@pytest.mark.parametrize("k,spread", [(1, 1), (7, 3), (40, 1024), (5000, 16)])
def test_top_per_group_is_exact_for_any_split(spark, k, spread):
    rows = hot_rows(seed=k)
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    want = {i for ids in groups.values() for i in ids[:k]}
    for parts in (1, 5, 23):
        df = spark.createDataFrame(rows, "row_id int, k string, v int").repartition(parts, "row_id")
        out = ranking.top_per_group(df, ["k"], [F.desc("v"), "row_id"], k, spread)
        assert {r["row_id"] for r in out.collect()} == want


def test_two_step_dedup_is_sequential(spark):
    rows = [(1, "t", "x", "bug"), (2, "t", "y", "bug"), (3, "u", "y", "bug"), (4, "u", "z", "bug"),
            (5, "t", "x", "question")]
    df = spark.createDataFrame(rows, "row_id int, title string, body string, label string")
    # 2 loses to 1 by title, so 3 keeps body y although 2 came before it
    assert sorted(r["row_id"] for r in ranking.dedup_title_then_body(df).collect()) == [1, 3, 5]
    assert sorted(r["row_id"] for r in ranking.dedup_title_body(df).collect()) == [1, 2, 3, 4]


def test_cap_per_label_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(i, "bug", 5) for i in range(20)] + [(99, "bug", 9)],
                               "row_id int, label string, n int")
    out = ranking.cap_per_label(df, 4, ("bug",), F.col("n"))
    assert sorted(r["row_id"] for r in out.collect()) == [0, 1, 2, 99]


def test_quota_overshoots_by_whole_repos(spark):
    counts = spark.createDataFrame([("bug", f"r{i}", 100 - i, 6) for i in range(5)],
                                   "label string, repo string, stars int, n long")
    taken = [r["repo"] for r in ranking.within_quota(counts, 10).collect()]
    assert sorted(taken) == ["r0", "r1"]
    have = spark.createDataFrame([("bug", 8)], "label string, have long")
    assert [r["repo"] for r in ranking.within_quota(counts, 10, have).collect()] == ["r0"]


def test_dense_index(spark):
    ids = random.Random(3).sample(range(10**15), 997) + [2**62, -5]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(7)
    got = {r["row_id"]: r["index"] for r in ranking.dense_index(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_shuffle_is_reproducible_and_whole(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = [r["row_id"] for r in ranking.shuffled(df, 42).collect()]
    b = [r["row_id"] for r in ranking.shuffled(df.repartition(9), 42).collect()]
    assert a == b and sorted(a) == list(range(500)) and a != sorted(a)


LONG = "This report explains the crash in detail. " * 20


@pytest.mark.parametrize("change,reason", [
    ({}, None),
    ({"is_pr": True, "login": "dependabot"}, "pr"),
    ({"login": "Renovate[bot]"}, "bot"),
    ({"user_type": "Bot"}, "bot"),
    ({"login": None, "user_type": None}, None),
    ({"title": "only three words"}, "short_title"),
    ({"title": None}, "short_title"),
    ({"body": " \n "}, "empty_body"),
    ({"body": None}, "empty_body"),
    ({"body": "too short."}, "short_body"),
    ({"body": "Steps to Reproduce: " + "do it. " * 20}, "template"),
    ({"body": "Steps to Reproduce: " + "do it. " * 50}, None),
    ({"state": "open", "comments": None}, "unacknowledged"),
    ({"state": "open", "comments": 2}, None),
    ({"body": "que los para " + LONG}, "non_english"),
    ({"body": "a b c d e " * 6}, "no_structure"),
    ({"body": "a b c d e " * 6 + "\n a"}, None),
])
def test_quality_gate_order(spark, change, reason):
    row = {"title": "a title of words", "body": LONG, "login": "ann", "user_type": "User",
           "state": "closed", "comments": 0, "is_pr": False} | change
    df = spark.createDataFrame([row], "title string, body string, login string, user_type string, "
                                      "state string, comments long, is_pr boolean")
    assert df.select(gates.rejection_reason().alias("r")).first()["r"] == reason


def test_batch_and_record_guards(spark):
    df = spark.createDataFrame([("t", None)] * 3, "title string, body string")
    assert gates.guard_batch(df, 3) is df
    with pytest.raises(ValueError):
        gates.guard_batch(df, 2)
    with pytest.raises(ValueError):
        gates.guard_batch(df.where("false"))
    with pytest.raises(ValueError):
        gates.guard_record("  ", None)


def test_emit_cuts_after_stripping(spark):
    df = spark.createDataFrame([(1, "r", " t ", "  " + "x" * 10_005, "bug")],
                               "id long, repo string, title string, body string, label string")
    row = gates.emit_record(df).first()
    assert row["title"] == "t" and row["body"] == "x" * 10_000


def test_spec_matching_equals_the_theta_join(spark):
    specs = discovery.spec_dim(spark)
    assert specs.count() == 40
    rng = random.Random(5)
    topics = ["react", "cli", "docker", "framework", "web", "none"]
    languages = ["javascript", "python", "rust", "c", None, "other"]
    repos = [(f"r{i}", rng.choice(languages), rng.sample(topics, 2), rng.randint(0, 20_000))
             for i in range(300)]
    df = spark.createDataFrame(repos, "full_name string, language string, topics array<string>, "
                                      "stars long")
    got = {(r["spec_id"], r["full_name"]) for r in discovery.match_specs(df, specs).collect()}
    want = {(s["spec_id"], name) for s in specs.collect() for name, lang, tops, stars in repos
            if s["language"] in (None, lang) and (s["topic"] is None or s["topic"] in tops)
            and stars > s["min_stars"]}
    assert got == want


def test_caps_and_shares():
    assert discovery.base_per_repo(10_000, 600) == 53
    assert discovery.base_per_repo(10, 0) == 30
    assert len(fixed.DISCOVERY_SPECS) == 40 and len(fixed.TEMPLATE_PHRASES) == 18


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "label string, repo string, body string, confidence double, "
                                      "source string")
    assert summary.balance_ratio(empty).first()["balance_ratio"] is None
    assert summary.placeholder_leak(empty).first()["placeholders"] == 0
    assert summary.class_shares(empty).count() == 0
    assert summary.source_counts(empty).first()["total"] == 0


def test_share_bar_and_rounding(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)], "label string")
    rows = {r["label"]: (r["n"], r["pct"], r["bar"]) for r in summary.class_shares(df).collect()}
    assert rows == {"a": (7, 87.5, "█" * 43), "b": (1, 12.5, "█" * 6)}
    from loamsift.functions.scores import round1
    vals = spark.sql("SELECT 86.25D a, 12.25D b").select(round1(F.col("a")), round1(F.col("b")))
    assert tuple(vals.first()) == (86.2, 12.2)


def test_class_report(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    cells = summary.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    got = {r["label"]: r for r in summary.class_report(cells).collect()}
    assert got["a"]["precision"] == 0.75 and got["a"]["recall"] == 0.75
    assert got["c"]["f1"] == 0 and got["c"]["support"] == 1
    assert summary.overall_report(cells).first()["accuracy"] == pytest.approx(5 / 7)
