"""Sources and sinks, curation, collecting, scoring, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import scores, text
from loamsift.operators import discovery, evaluation, gates, scoring, sketches, summary
from loamsift.operators.ranking import first_per_key
from loamsift.plans import collect as collecting
from loamsift.plans import curate as curation
from loamsift.plans import score as scoreplan
from loamsift.session import app_folder, scratch_path, stash
from loamsift.sources import readers, scorers, writers
from loamsift.streaming import late, streams
from suite import duck, views
from suite.registry import query
from suite.table_queries import ALIAS_DIM
from suite.views import cte, issues, repos, score_log

_I = cte(issues=views.ISSUES)
_LOG = cte(log=views.SCORE_LOG)


# --- sources and sinks: every query writes given rows and reads them back ---
_RAW = """SELECT row_id, repo, CASE WHEN comments = 3 THEN 'N/A' ELSE title END AS title,
  CASE WHEN comments = 1 THEN 'nan' WHEN comments = 2 THEN '' ELSE body END AS body FROM issues"""


@query("S01_csv_scan", f"""WITH raw AS ({_I} {_RAW})
SELECT CAST(row_id AS VARCHAR) AS row_id, repo, nullif(title, 'N/A') AS title,
nullif(nullif(body, 'nan'), '') AS body FROM raw""")
def _(spark, d):
    path = scratch_path(spark, "csv")
    raw = issues(spark, d).selectExpr(
        "row_id", "repo", "CASE WHEN comments = 3 THEN 'N/A' ELSE title END AS title",
        "CASE WHEN comments = 1 THEN 'nan' WHEN comments = 2 THEN '' ELSE body END AS body")
    writers.write_csv(raw.select("body", "title", "row_id", "repo"), path)  # another order
    return readers.read_csv(spark, path, ("row_id", "repo", "title", "body"))


@query("S01_file_order", f"""{_I} SELECT repo, title FROM issues
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY row_id % 10 <> 0, row_id) = 1""")
def _(spark, d):
    """A small folder and a large one: the row of the earlier file wins a tie."""
    return _first_in_files(spark, d, split=False)


@query("S01_csv_split", f"""{_I} SELECT repo, title FROM issues
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY row_id % 10 <> 0, row_id) = 1""")
def _(spark, d):
    """The same through blocks of the files, bodies with newlines included."""
    return _first_in_files(spark, d, split=True)


def _first_in_files(spark, d, split):
    path = scratch_path(spark, "ordered-csv")
    for name, part in (("a", "row_id % 10 = 0"), ("b", "row_id % 10 <> 0")):
        rows = issues(spark, d).where(part).select("row_id", "repo", "title", "body")
        # part files are numbered in the order of the ranges
        ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
        writers.write_csv(ordered.drop("row_id"), f"{path}/{name}")
    scan = readers.read_csv(spark, f"{path}/*", ("repo", "title", "body"), split)
    stored = readers.store_with_row_ids(scan, f"{path}-stored")
    return first_per_key(stored, ["repo"], ["row_id"]).select("repo", "title")


@query("S02_header", f"{_I} SELECT repo, title, label FROM issues")
def _(spark, d):
    df = issues(spark, d).select(F.col("repo").alias(" Repo"), F.col("title").alias("TITLE "),
                                 F.col("label").alias("Label"))
    return readers.normalise_header(df)


@query("S03_missing_columns", f"{_I} SELECT row_id, title, '' AS body, '' AS label FROM issues")
def _(spark, d):
    df = readers.require_columns(issues(spark, d).select("row_id", "title"), ("title",))
    return readers.with_defaults(df, ("title", "body", "label"))


@query("S04_issue_pages", f"""{_I} SELECT id, repo, title, body, state, coalesce(comments, -1) AS comments,
login, user_type, is_pr, alias1 FROM issues""")
def _(spark, d):
    path = scratch_path(spark, "landing")
    df = issues(spark, d)
    good = df.select(F.to_json(F.struct(
        "id", "repo", "title", "body", "state", "comments",
        F.struct(F.col("login"), F.col("user_type").alias("type")).alias("user"),
        F.when(F.col("is_pr"), F.struct(F.lit("u").alias("url"))).alias("pull_request"),
        F.array("alias1", "alias2").alias("labels"))).alias("value"))
    errors = df.select(F.to_json(F.struct(F.lit("rate limit").alias("message"))).alias("value"))
    broken = df.select(F.concat(F.lit("<html>"), F.col("repo").cast("string")).alias("value"))
    good.unionByName(errors).unionByName(broken).write.text(path)
    flat = readers.flatten_issue(readers.read_issue_pages(spark, path))
    return flat.withColumn("alias1", F.col("labels")[0]).withColumn(
        "comments", F.coalesce("comments", F.lit(-1))).drop("labels", "updated_at")


@query("S05_repo_pages", f"""{cte(repos=views.REPOS)} SELECT full_name, stars, issues,
coalesce(language, '') AS language, archived, coalesce(fork, false) AS fork, topic1 FROM repos""")
def _(spark, d):
    path = scratch_path(spark, "repo-pages")
    item = F.struct("full_name", F.col("stars").alias("stargazers_count"),
                    F.col("issues").alias("open_issues_count"), "language", "archived",
                    "disabled", "fork", "topics")
    page = F.floor(F.col("p_partkey") / fixed.REPOS_PER_PAGE)
    (repos(spark, d).groupBy(page.alias("page")).agg(F.collect_list(item).alias("items"))
     .select("items").write.json(path))
    return readers.read_repo_pages(spark, path).select(
        "full_name", "stars", "issues", "language", "archived",
        F.coalesce("fork", F.lit(False)).alias("fork"), F.col("topics")[0].alias("topic1"))


@query("S06_upload_by_suffix", f"""{_I} SELECT title, body FROM issues
UNION ALL SELECT title, body FROM issues UNION ALL SELECT title, '' FROM issues""")
def _(spark, d):
    df = issues(spark, d).select(F.col("title").alias("Title"), "body")
    as_csv, as_json, as_parquet = (scratch_path(spark, "up") + s
                                   for s in (".csv", ".json", ".parquet"))
    writers.write_csv(df, as_csv)
    writers.write_json(df, as_json)
    df.select("Title").write.parquet(as_parquet)
    parts = [readers.read_upload(spark, p).select("title", "body")
             for p in (as_csv, as_json, as_parquet)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S07_label_config", """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id,
label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS declared_id
FROM (SELECT DISTINCT event_type AS label FROM events)""")
def _(spark, d):
    from pyspark.sql import Window
    path = scratch_path(spark, "label-config")
    ids = score_log(spark, d).select("label").distinct().withColumn(
        "i", F.row_number().over(Window.orderBy("label")) - 1)
    entries = ids.agg(
        F.map_from_entries(F.collect_list(F.struct("label", "i"))).alias("labels"),
        F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("string"), "label")))
        .alias("id2label"))
    writers.write_json(entries, path)
    return readers.label_names(readers.read_label_config(spark, path))


@query("S08_metrics_history", """SELECT CAST(hour(ts) AS INT) AS step, count(*) AS n,
0.0::DOUBLE AS test_acc, '' AS test_report FROM events GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "metrics")
    hours = score_log(spark, d).groupBy(F.hour("ts").alias("h")).agg(
        F.count("*").cast("double").alias("n"))
    history = hours.agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("hs")).select(
        F.transform("hs", lambda x: F.create_map(F.lit("n"), x["n"])).alias("history"))
    writers.write_json(history, path)
    return readers.read_metrics(spark, path).select(
        "step", F.col("entry")["n"].cast("long").alias("n"), "test_acc", "test_report")


@query("S09_csv_sink", f"{_I} SELECT title, body FROM issues")
def _(spark, d):
    path = scratch_path(spark, "csv-sink")
    writers.write_csv(issues(spark, d).select("title", "body"), path)
    return readers.read_csv(spark, path, ("title", "body"))


@query("S10_json_sink", f"{_I} SELECT row_id, title, body FROM issues")
def _(spark, d):
    path = scratch_path(spark, "json-sink")
    writers.write_json(issues(spark, d).select("row_id", "title", "body"), path)
    return spark.read.schema("row_id long, title string, body string").json(path)


@query("S12_resume_state", f"""{cte(seen=views.SEEN, done=views.DONE)}
SELECT 'seen' AS part, CAST(id AS VARCHAR) AS key FROM seen
UNION ALL SELECT 'done', label || '|' || repo FROM done""")
def _(spark, d):
    path = scratch_path(spark, "state")
    writers.save_state(path, views.seen_ids(spark, d), views.done_pairs(spark, d))
    seen, done = readers.read_state(spark, path)
    return seen.select(F.lit("seen").alias("part"), F.col("id").cast("string").alias("key")
                       ).unionByName(done.select(F.lit("done").alias("part"),
                                                 F.concat_ws("|", "label", "repo").alias("key")))


@query("S12_state_replayed", f"""{cte(seen=views.SEEN, done=views.DONE)}
SELECT 'seen' AS part, CAST(id AS VARCHAR) AS key, true AS fresh FROM seen
UNION ALL SELECT 'done', label || '|' || repo, true FROM done""")
def _(spark, d):
    """The same run saved twice, as after a restart, on top of one half saved by another."""
    path = scratch_path(spark, "state")
    seen, done = views.seen_ids(spark, d), views.done_pairs(spark, d)
    writers.save_state(path, seen.where("id % 2 = 0"), done.limit(0), "first")
    fresh = writers.save_state(path, seen.where("id % 2 = 1"), done, "second")
    again = writers.save_state(path, seen, done, "second")
    ids, pairs = readers.read_state(spark, path)
    flag = F.lit(fresh and not again).alias("fresh")
    return ids.select(F.lit("seen").alias("part"), F.col("id").cast("string").alias("key"), flag
                      ).unionByName(pairs.select(F.lit("done").alias("part"),
                                                 F.concat_ws("|", "label", "repo").alias("key"), flag))


_LOG_ROWS = f"""{_LOG} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, label,
confidence, source, uid FROM log"""


def _log_rows(log):
    return log.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "label",
                      "confidence", "source", F.col("user").alias("uid"))


@query("S14_score_log", _LOG_ROWS)
def _(spark, d):
    path = scratch_path(spark, "log")
    log = score_log(spark, d)
    for source in ("single", "batch"):
        writers.append_log(log.where(F.col("source") == source), path)
    return _log_rows(readers.read_log(spark, path))


@query("S14_log_replayed", _LOG_ROWS)
def _(spark, d):
    """Batches that come twice: one is skipped, one replaces a half that was wrong."""
    path = scratch_path(spark, "log")
    log = score_log(spark, d)
    single, batch = (log.where(F.col("source") == s) for s in ("single", "batch"))
    writers.append_log(single, path, "a")
    writers.append_log(single, path, "a")
    writers.append_log(batch.withColumn("confidence", F.lit(0.0)), path, "b")
    writers.append_log(batch, path, "b", replace=True)
    return _log_rows(readers.read_log(spark, path))


@query("W07_timeline_of_stored_log", f"""{_LOG}, t AS (SELECT ts, label, confidence, source, uid FROM log
ORDER BY ts DESC, label DESC, confidence DESC, source DESC, uid DESC LIMIT 120)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, label, confidence, source, uid FROM t""")
def _(spark, d):
    """The last rows of a log by days: only the newest days are opened."""
    path = scratch_path(spark, "log")
    writers.append_log(score_log(spark, d), path)
    return _log_rows(summary.timeline(readers.read_newest(spark, path, fixed.TIMELINE_ROWS)))


# --- curation --------------------------------------------------------------
def _curated_ctes(recipe: curation.Recipe) -> str:
    final = recipe.name == "final"
    label = f"lower({duck.strip('label')})"
    screen = (f"regexp_matches(title, {duck.q(duck.BOT_MENTION)}) OR "
              f"regexp_matches(body, {duck.q(duck.BOT_MENTION)})" if final
              else f"regexp_matches(left(body, 500), {duck.q(duck.SPAM)})")
    first = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY row_id) = 1"
    dedup = (f"dd AS (SELECT * FROM (SELECT * FROM en {first.format('title, label')}) "
             f"{first.format('body, label')})" if final
             else f"dd AS (SELECT * FROM en {first.format('title, body')})")
    return f"""{_I},
lb AS (SELECT row_id, repo, title, body, {label} AS label FROM issues
  WHERE {label} IN {duck.names(recipe.labels)}),
sc AS (SELECT * FROM lb WHERE NOT ({screen})),
cl AS ({duck.cleaned(recipe.name, 'sc')}),
wd AS (SELECT *, {duck.wc('body')} AS wc FROM cl
  WHERE {duck.wc('title')} >= {recipe.min_title_words} AND {duck.wc('body')} >= {recipe.min_body_words}),
en AS (SELECT * FROM wd WHERE {duck.english('title', 'body', recipe.name)}),
{dedup},
ba AS (SELECT * FROM dd QUALIFY row_number() OVER (
  PARTITION BY label ORDER BY wc DESC, row_id) <= {recipe.cap}),
va AS (SELECT * FROM ba WHERE repo IS NOT NULL AND {duck.strip('repo')} <> '')"""


def _funnel_sql(recipe: curation.Recipe) -> str:
    tables = ("issues", "lb", "sc", "wd", "en", "dd", "ba", "va")
    rows = " UNION ALL ".join(
        f"SELECT {i} AS stage_no, {duck.q(s)} AS stage, count(*) AS n FROM {t}"
        for i, (s, t) in enumerate(zip(recipe.stages, tables), 1))
    return f"{_curated_ctes(recipe)}, fu AS ({rows})"


def _curation(recipe: curation.Recipe) -> None:
    version = recipe.name

    @query(f"curate_{version}",
           f"{_curated_ctes(recipe)} SELECT row_id, repo, title, body, label FROM va")
    def run(spark, d):
        return curation.curate(issues(spark, d), recipe)

    tight = recipe._replace(cap=40)

    @query(f"curate_{version}_cap_of_40", f"{_curated_ctes(tight)} SELECT row_id, label FROM va")
    def capped(spark, d):
        return curation.curate(issues(spark, d), tight).select("row_id", "label")

    @query(f"A11_funnel_{version}", f"{_funnel_sql(recipe)} SELECT stage_no, stage, n FROM fu")
    def funnel(spark, d):
        return curation.Curation(issues(spark, d), recipe).funnel()

    @query(f"A15_removed_{version}", f"""{_funnel_sql(recipe)} SELECT stage_no, stage, n,
coalesce(lag(n) OVER (ORDER BY stage_no) - n, 0) AS removed FROM fu""")
    def removed(spark, d):
        return summary.removed_per_stage(curation.Curation(issues(spark, d), recipe).funnel())


_curation(curation.V3)
_curation(curation.FINAL)


@query("S11_report", f"""{_funnel_sql(curation.FINAL)}
SELECT '1 stages' AS section, stage AS metric, format('{{:,}}', n) AS value FROM fu
UNION ALL SELECT '2 retention', 'retention_pct', CAST(round_even(100.0 * max_by(n, stage_no) / min_by(n, stage_no), 1) AS VARCHAR) FROM fu
UNION ALL SELECT '3 classes', label, format('{{:,}}', count(*)) || ' (' || printf('%.1f',
  round_even(100.0 * count(*) / sum(count(*)) OVER (), 1)) || '%)' FROM va GROUP BY label
UNION ALL SELECT '4 balance', 'balance_ratio', printf('%.2f', max(n) / min(n))
  FROM (SELECT count(*) AS n FROM va GROUP BY label)
UNION ALL SELECT '5 words', c || '_' || stat, v FROM (SELECT c, unnest(['mean', 'median', 'min', 'max']) AS stat,
  unnest([printf('%.1f', round_even(round(avg(n), 9), 1)), printf('%.1f', round_even(median(n), 1)),
  printf('%.1f', CAST(min(n) AS DOUBLE)), printf('%.1f', CAST(max(n) AS DOUBLE))]) AS v FROM (
  SELECT 'title' AS c, {duck.wc('title')} AS n FROM va UNION ALL SELECT 'body', {duck.wc('body')} FROM va)
  GROUP BY c)
UNION ALL SELECT '6 leak', 'placeholders', CAST(sum(len(regexp_extract_all(body,
  '\\[(CODE|URL|VERSION|FILEPATH|HASH)\\]'))) AS BIGINT)::VARCHAR FROM va
UNION ALL SELECT '7 cells', 'nulls', CAST(sum((repo IS NULL)::INT + (title IS NULL)::INT
  + (body IS NULL)::INT + (label IS NULL)::INT) AS BIGINT)::VARCHAR FROM va
UNION ALL SELECT '7 cells', 'empties', CAST(sum((trim(repo) = '')::INT + (trim(title) = '')::INT
  + (trim(body) = '')::INT + (trim(label) = '')::INT) AS BIGINT)::VARCHAR FROM va""")
def _(spark, d):
    return curation.Curation(issues(spark, d), curation.FINAL).report().select(
        "section", "metric", "value")


# --- collecting ------------------------------------------------------------
_SOURCES = """SELECT repo AS full_name, count(*) AS stars, count(*) * 2 AS issues FROM issues
  GROUP BY repo"""


def _collect_run(run: str, target: int, seen: str, done: str, have: str) -> str:
    """CTEs of one collecting run; ``{run}em`` has its rows, ``{run}tk`` its finished pairs.

    ``seen``, ``done`` and ``have`` are tables (id), (label, repo) and (label, have).
    """
    parts = [f"""{run}x AS (SELECT x.*, coalesce(h.have, 0) AS have FROM x LEFT JOIN {have} h
  ON h.label = x.label WHERE coalesce(h.have, 0) < {target}
  AND NOT EXISTS (SELECT 1 FROM {done} d WHERE d.label = x.label AND d.repo = x.repo)),
{run}pg AS (SELECT * FROM {run}x QUALIFY row_number() OVER (PARTITION BY repo, alias
  ORDER BY id DESC) <= 1000),
{run}uq AS (SELECT * FROM {run}pg QUALIFY row_number() OVER (
  PARTITION BY id, label ORDER BY alias_rank) = 1),
{run}ns AS (SELECT * FROM {run}uq WHERE id NOT IN (SELECT id FROM {seen})),
{run}gt AS (SELECT *, {duck.strip('title')} AS t, {duck.strip('body')} AS b FROM {run}ns),
{run}rj AS (SELECT *, {duck.REASON} AS reason FROM {run}gt)"""]
    emitted, taken = [], []
    for i, label in enumerate(fixed.LABELS_COLLECT):
        n = f"{run}{i}"
        before = "".join(f" AND id NOT IN (SELECT id FROM {e})" for e in emitted)
        parts.append(f"""{n}cp AS (SELECT * FROM {run}rj WHERE reason IS NULL AND label = {duck.q(label)}{before}
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY alias_rank, id DESC)
  <= least(30, greatest(20, issues // 5))),
{n}ct AS (SELECT l.repo, l.stars, l.have, count(c.id) AS n FROM (SELECT DISTINCT repo, stars, have
  FROM {run}ns WHERE label = {duck.q(label)}) l LEFT JOIN {n}cp c ON c.repo = l.repo GROUP BY ALL),
{n}tk AS (SELECT {duck.q(label)} AS label, repo FROM (SELECT *, coalesce(sum(n) OVER (
  ORDER BY stars DESC, repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {n}ct) WHERE before + have < {target}),
{n}em AS (SELECT * FROM {n}cp WHERE repo IN (SELECT repo FROM {n}tk))""")
        emitted.append(f"{n}em")
        taken.append(f"{n}tk")
    union = lambda names: " UNION ALL ".join(f"SELECT * FROM {x}" for x in names)
    return ",\n".join([*parts, f"{run}em AS ({union(emitted)})", f"{run}tk AS ({union(taken)})"])


_COLLECT = f"""{_I}, aliases AS ({ALIAS_DIM}), dim AS (SELECT repo AS full_name, count(*) AS stars,
  count(*) * 2 AS issues FROM issues GROUP BY repo),
x AS (SELECT i.* EXCLUDE (label), a.label, a.label_rank, a.alias_rank, a.alias, r.stars, r.issues
  FROM (SELECT *, unnest([alias1, alias2]) AS al FROM issues WHERE state = 'closed') i
  JOIN aliases a ON a.alias = i.al JOIN dim r ON r.full_name = i.repo),
seen0 AS (SELECT doc_id AS id FROM labels), done0 AS (SELECT label, repo FROM x WHERE false),
have0 AS (SELECT DISTINCT label, 0 AS have FROM aliases)"""
_EMITTED = "id, repo, t AS title, left(b, 10000) AS body, label"


def _landed(spark, d):
    df = issues(spark, d).drop("label").withColumn(
        "labels", F.array("alias1", "alias2")).withColumn("updated_at", F.timestamp_seconds("id"))
    dim = df.groupBy(F.col("repo").alias("full_name")).agg(
        F.count("*").alias("stars"), (F.count("*") * 2).alias("issues"))
    seen = views.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    done = spark.createDataFrame([], "label string, repo string")
    have = discovery.label_dim(spark).select("label", F.lit(0).cast("long").alias("have"))
    return df, discovery.top_repos(dim), discovery.alias_dim(spark), seen, done, have


@query("collect_records", f"""{_COLLECT}, {_collect_run('a', 25, 'seen0', 'done0', 'have0')}
SELECT {_EMITTED} FROM aem""")
def _(spark, d):
    return collecting.collect(*_landed(spark, d), target=25).rows


@query("collect_resumed", f"""{_COLLECT}, {_collect_run('a', 8, 'seen0', 'done0', 'have0')},
seen1 AS (SELECT id FROM seen0 UNION SELECT id FROM aem UNION SELECT id FROM arj WHERE reason IS NOT NULL),
have1 AS (SELECT label, count(*) AS have FROM aem GROUP BY label),
{_collect_run('b', 25, 'seen1', 'atk', 'have1')}
SELECT 1 AS run, {_EMITTED} FROM aem UNION ALL SELECT 2, {_EMITTED} FROM bem""")
def _(spark, d):
    """A run with a small target, its state stored, and a run with a larger one that reads it."""
    df, repos_, aliases, seen, done, have = _landed(spark, d)
    path = scratch_path(spark, "collect-state")
    first = collecting.collect(df, repos_, aliases, seen, done, have, target=8)
    writers.save_state(path, seen.unionByName(first.seen.select("id")), first.done)
    seen1, done1 = readers.read_state(spark, path)
    have1 = first.rows.groupBy("label").agg(F.count("*").alias("have"))
    second = collecting.collect(df, repos_, aliases, seen1, done1, have1, target=25)
    return first.rows.withColumn("run", F.lit(1)).unionByName(
        second.rows.withColumn("run", F.lit(2)))


# --- scoring ---------------------------------------------------------------
LABELS = fixed.LABELS_MODEL
# five logits, each the sum of a block of the vector's 64 values
_BLOCKS = ((1, 13), (14, 13), (27, 13), (40, 13), (53, 12))
_SUMS = ", ".join(f"list_sum(list_transform(embedding[{a}:{a + n - 1}], lambda v: CAST(v AS DOUBLE)))"
                  f" AS x{i}" for i, (a, n) in enumerate(_BLOCKS, 1))
_SOFT = f"""WITH e AS (SELECT vec_id, label AS given, {_SUMS} FROM embeddings),
m AS (SELECT *, greatest(x1, x2, x3, x4, x5) AS hi FROM e),
z AS (SELECT *, exp(x1 - hi) AS z1, exp(x2 - hi) AS z2, exp(x3 - hi) AS z3, exp(x4 - hi) AS z4,
  exp(x5 - hi) AS z5 FROM m),
p AS (SELECT vec_id, given, z1 / (z1+z2+z3+z4+z5) AS p1, z2 / (z1+z2+z3+z4+z5) AS p2,
  z3 / (z1+z2+z3+z4+z5) AS p3, z4 / (z1+z2+z3+z4+z5) AS p4, z5 / (z1+z2+z3+z4+z5) AS p5 FROM z),
s AS (SELECT *, greatest(p1, p2, p3, p4, p5) AS best,
  CASE greatest(p1, p2, p3, p4, p5) WHEN p1 THEN 'bug' WHEN p2 THEN 'documentation'
    WHEN p3 THEN 'enhancement' WHEN p4 THEN 'performance' ELSE 'question' END AS predicted_label
  FROM p)"""
_WIDE = ", ".join(f'round_even(p{i} * 100, 1) AS "score_{x}"' for i, x in enumerate(LABELS, 1))


def _logits():
    return F.array(*[F.aggregate(F.slice("embedding", a, n), F.lit(0.0),
                                 lambda t, v: t + v.cast("double")) for a, n in _BLOCKS])


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("given"), _logits().alias("e"), "embedding")


def _decoded(spark, d):
    return scoring.decode_logits(_vectors(spark, d), "e", LABELS)


@query("F15_softmax", f"""{_SOFT} SELECT vec_id, round(p1, 6) AS p1, round(p2, 6) AS p2,
round(p3, 6) AS p3, round(p4, 6) AS p4, round(p5, 6) AS p5 FROM p""")
def _(spark, d):
    p = _vectors(spark, d).select("vec_id", scores.softmax(F.col("e")).alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(5)])


@query("F16_argmax", f"""{_SOFT} SELECT vec_id, CASE WHEN x1 = hi THEN 0 WHEN x2 = hi THEN 1
WHEN x3 = hi THEN 2 WHEN x4 = hi THEN 3 ELSE 4 END AS i FROM m""")
def _(spark, d):
    return _vectors(spark, d).select("vec_id", scores.argmax(F.col("e")).cast("int").alias("i"))


@query("F17_percent_map", f"""{_SOFT} SELECT vec_id, 5 AS n, round_even(p1 * 100, 1) AS bug,
round_even(p5 * 100, 1) AS question FROM p""")
def _(spark, d):
    m = _vectors(spark, d).select("vec_id", scores.percent_map(
        scores.softmax(F.col("e")), LABELS).alias("m"))
    return m.select("vec_id", F.size("m").alias("n"), F.col("m")["bug"].alias("bug"),
                    F.col("m")["question"].alias("question"))


@query("F18_wide_scores", f"{_SOFT} SELECT vec_id, {_WIDE}, 0.0::DOUBLE AS score_refactor FROM s")
def _(spark, d):
    cols = scores.score_columns(F.col("confidences"), LABELS + ("refactor",))
    return _decoded(spark, d).select("vec_id", *[c.alias(n) for n, c in cols.items()])


@query("M01_pair_text", f"""{_I} SELECT row_id, {duck.strip('title')} ||
CASE WHEN {duck.strip('body')} = '' THEN '' ELSE ' ' || {duck.strip('body')} END AS text FROM issues""")
def _(spark, d):
    return issues(spark, d).select("row_id", scoring.pair_text().alias("text"))


@query("M02_batch_scorer", f"""{_SOFT} SELECT vec_id, predicted_label,
round_even(best * 100, 1) AS confidence FROM s""")
def _(spark, d):
    def load():
        """A linear model over the whole vector: its weights pick the blocks."""
        import numpy as np
        weights = np.zeros((64, len(blocks)))
        for i, (start, n) in enumerate(blocks):
            weights[start - 1:start - 1 + n, i] = 1
        return lambda batch: np.stack(batch.to_numpy()).astype("float64") @ weights
    blocks = _BLOCKS
    scored = scoring.with_logits(_vectors(spark, d), F.col("embedding"), load, len(LABELS))
    return scoring.decode_logits(scored, "logits", LABELS).select(
        "vec_id", "predicted_label", "confidence")


_WORD_SIZES = "list_transform(range(5), lambda i: len(list_filter(w, lambda x: length(x) % 5 = i)))"


@query("M02_token_budget", f"""{_I}, w AS (SELECT row_id, regexp_extract_all(body, '[^ \\t\\n\\r\\x0b\\x0c]+') AS w FROM issues),
c AS (SELECT row_id, {_WORD_SIZES} AS c FROM w)
SELECT row_id, list_extract(c, 1) AS c0, list_extract(c, 5) AS c4, true AS saved FROM c""")
def _(spark, d):
    """Counts of words by length as logits, in batches cut by tokens; far less padding than in row order."""
    def load():
        import re
        import numpy as np
        word = re.compile("[^ \\t\\n\\r\\x0b\\x0c]+")
        return lambda batch: np.array([np.bincount([len(w) % 5 for w in word.findall(t)] or [0], minlength=5)
                                       - ([1, 0, 0, 0, 0] if not word.search(t) else [0] * 5) for t in batch])
    rows = issues(spark, d).select("row_id", "body")
    counted = scoring.word_tokens(384)
    scored = scoring.with_logits(rows, F.col("body"), load, 5, budget=64 * 384, tokens=counted)
    lengths = counted(rows.select("body").limit(2000).toPandas()["body"])  # a sample measures the padding
    own, sorted_ = (scoring.padded_tokens(lengths, scoring.token_batches(lengths, 64 * 384, by_length=b))
                    for b in (False, True))
    return scored.select("row_id", F.col("logits")[0].cast("long").alias("c0"),
                         F.col("logits")[4].cast("long").alias("c4"), F.lit(sorted_ < own).alias("saved"))


@query("M04_decode", f"""{_SOFT} SELECT vec_id, predicted_label,
round_even(best * 100, 1) AS confidence, CASE predicted_label
{' '.join(f"WHEN {duck.q(x)} THEN {duck.q(fixed.PALETTE[i])}" for i, x in enumerate(LABELS))} END AS color
FROM s""")
def _(spark, d):
    return _decoded(spark, d).select("vec_id", "predicted_label", "confidence", "color")


@query("M05_label_codec", f"""SELECT vec_id, given % 5 AS label_id, CASE given % 5
{' '.join(f"WHEN {i} THEN {duck.q(x)}" for i, x in enumerate(LABELS))} END AS label,
given % 5 AS again FROM (SELECT vec_id, label AS given FROM embeddings)""")
def _(spark, d):
    names, ids = {str(i): x for i, x in enumerate(LABELS)}, {x: i for i, x in enumerate(LABELS)}
    label_id = F.col("given") % 5
    return _vectors(spark, d).select("vec_id", label_id.alias("label_id"),
                                     scores.decode_label(label_id, names).alias("label")
                                     ).withColumn("again", scores.encode_label(F.col("label"), ids))


@query("M06_class_weights", f"""{_I}, c AS (SELECT lower({duck.strip('label')}) AS label, count(*) AS n
FROM issues GROUP BY 1) SELECT label, n,
round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""")
def _(spark, d):
    df = issues(spark, d).withColumn("label", gates.normalised_label())
    return summary.class_weights(df).withColumn("weight", F.round("weight", 6))


# Documents by language: a text model can learn it, unlike the labels of the issue view.
_LANGUAGES = {"en": "bug", "de": "documentation", "fr": "enhancement", "es": "question"}
_TAUGHT = f"""{_I}, tr AS (SELECT row_id, title, CASE d.lang {" ".join(
    f"WHEN {duck.q(k)} THEN {duck.q(v)}" for k, v in _LANGUAGES.items())} ELSE 'question' END AS label
  FROM issues JOIN documents d ON d.doc_id = row_id)"""


def _training_rows(spark, d):
    """row_id, title, body, text, label: issues with the language of their document as label.

    A row is its own document; only rows of repeated ids meet others, so texts are not shuffled.
    """
    names = F.create_map(*[F.lit(x) for kv in _LANGUAGES.items() for x in kv])
    label = F.coalesce(F.element_at(names, F.col("lang")), F.lit("question"))
    docs = views.documents(spark, d).select(F.col("doc_id").alias("row_id"), label.alias("_other"))
    again = docs.groupBy("row_id").count().where("count > 1 AND row_id IS NOT NULL")
    others = stash(docs.join(again.select("row_id"), "row_id", "left_semi"), "repeated")
    rows = issues(spark, d, "lang").where("row_id IS NOT NULL").select(
        "row_id", "title", "body", scoring.pair_text().alias("text"), label.alias("_own"))
    return rows.join(others, "row_id", "left").withColumn(
        "label", F.coalesce("_other", "_own")).drop("_own", "_other")


def _taught_terms(spark, d):
    """row_id, label and the word counts of the text: every text is split once, here."""
    return stash(scoring.count_terms(_training_rows(spark, d)).select("row_id", "label", scoring.TERMS), "terms")


def _stored_scorer(spark, d, terms=None):
    """The scorer stored for these tables; the first call of an application trains and stores it."""
    path = f"{app_folder(spark)}/scorer-{abs(hash(d))}"
    if not scorers.has_scorer(spark, path):
        rows = (_taught_terms(spark, d) if terms is None else terms).where(evaluation.fold_of("row_id", 5) != 0)
        scorers.save_scorer(scoring.train_classifier(rows.select("label", scoring.TERMS)), LABELS, path, spark)
    return scorers.load_scorer(spark, path)


@query("M03_single_record", f"""{_I} SELECT title, true AS as_in_batch, true AS in_config FROM issues
WHERE row_id = 0""")
def _(spark, d):
    """One record and the batch that holds it, by the stored scorer: nothing is trained."""
    scorer = _stored_scorer(spark, d)
    row = issues(spark, d).where("row_id = 0").first()
    other = scorer(_training_rows(spark, d)).where("row_id = 0").first()
    one = scoring.score_record(spark, row["title"], row["body"], scorer)
    same = (F.col("predicted_label") == other["predicted_label"]) & (F.col("confidence") == other["confidence"])
    return one.select(
        "title", same.alias("as_in_batch"),
        F.col("predicted_label").isin(*scorer.labels).alias("in_config"))


@query("M07_train_and_score", f"""{_TAUGHT} SELECT row_id, label, true AS known, true AS better FROM tr""")
def _(spark, d):
    """Every row by the stored model, whose accuracy on the rows it has not seen beats the largest class."""
    rows = _taught_terms(spark, d)
    scorer = _stored_scorer(spark, d, rows)
    scored = stash(scorer(rows).select("row_id", "label", "predicted_label"), "scored")
    report = evaluation.evaluate(scored.where(evaluation.fold_of("row_id", 5) == 0))
    better = report.agg(F.first("accuracy") > (1 + F.first("majority")) / 2).first()[0]
    return scored.select("row_id", "label", F.col("predicted_label").isin(*scorer.labels).alias("known"),
                         F.lit(better).alias("better"))


_PLAIN_REPORT = """WITH c AS (SELECT label AS name FROM {p} GROUP BY label),
k AS (SELECT name AS label, count_if(label = name) AS support, count_if(predicted_label = name) AS named,
  count_if(label = name AND predicted_label = name) AS hits FROM {p}, c GROUP BY name)
SELECT label, support, hits, CASE WHEN named > 0 THEN hits / named ELSE 0 END AS precision,
  hits / support AS recall, 2 * hits / (named + support) AS f1 FROM k"""


@query("M08_held_out", f"""{_TAUGHT} SELECT label, count(*) AS support, count(*) AS predictions,
true AS report_is_plain, true AS better, true AS f1_sound FROM tr GROUP BY label""")
def _(spark, d):
    """Three folds by hash, stored predictions, and the report checked against plain SQL over them."""
    path = scratch_path(spark, "predictions")
    predictions = evaluation.cross_predictions(_taught_terms(spark, d), 3, scoring.train_classifier,
                                               scoring.score_with_model, path=path, inputs=("label", scoring.TERMS))
    report = evaluation.evaluate(predictions)
    plain = spark.sql(_PLAIN_REPORT, p=predictions)
    once = predictions.groupBy("label").agg(F.countDistinct("row_id").alias("predictions"))
    close = lambda c: F.abs(F.col(f"r.{c}") - F.col(f"q.{c}")) < 1e-9
    return report.alias("r").join(plain.alias("q"), "label").join(once, "label").select(
        "label", F.col("r.support").cast("long").alias("support"), "predictions",
        ((F.col("r.support") == F.col("q.support")) & (F.col("r.hits") == F.col("q.hits")) & close("precision")
         & close("recall") & close("f1")).alias("report_is_plain"),
        (F.col("accuracy") > (1 + F.col("majority")) / 2).alias("better"),
        ((F.col("macro_f1") > 0.5) & (F.col("r.hits") <= F.col("r.support"))).alias("f1_sound"))


_CELLS = """WITH r AS (SELECT l.quality AS truth, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
k AS (SELECT c AS label, count(*) FILTER (truth = c AND pred = c) AS tp,
  count(*) FILTER (truth = c) AS support, count(*) FILTER (pred = c) AS predicted
  FROM r, (VALUES (0), (1)) v(c) GROUP BY c),
f AS (SELECT label, support, tp AS hits,
  CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END AS f1 FROM k)"""


def _cells(spark, d):
    docs = views.table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") > 1000).cast("int").alias("pred"))
    rows = views.table(spark, d, "labels").join(docs, "doc_id")
    return summary.confusion(rows, "quality", "pred")


@query("M08_class_report", f"""{_CELLS} SELECT label, round(precision, 6) AS precision,
round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f""")
def _(spark, d):
    return summary.class_report(_cells(spark, d)).select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("M08_overall", f"""{_CELLS} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
round(avg(f1), 6) AS macro_f1 FROM f""")
def _(spark, d):
    return summary.overall_report(_cells(spark, d)).select(
        F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("M09_batch_summary", f"""{_SOFT}, c AS (SELECT predicted_label,
round_even(best * 100, 1) AS confidence FROM s)
SELECT predicted_label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
round_even(round(CAST(sum(sum(CAST(confidence AS DECIMAL(18, 6)))) OVER () AS DOUBLE)
  / sum(count(*)) OVER (), 9), 1) AS avg_confidence
FROM c GROUP BY predicted_label""")
def _(spark, d):
    return scoring.batch_summary(_decoded(spark, d))


@query("M10_wide_table", f"""{_SOFT} SELECT vec_id, given, predicted_label,
round_even(best * 100, 1) AS "confidence_%", {_WIDE} FROM s""")
def _(spark, d):
    return scoring.wide_scores(_decoded(spark, d), LABELS, ["vec_id", "given"])


@query("S13_scored_batch", f"""{_SOFT} SELECT vec_id, predicted_label, 8 AS id_length FROM s""")
def _(spark, d):
    path = scratch_path(spark, "batches")
    bid = spark.range(1).select(scores.batch_id().alias("b")).first()["b"]
    wide = scoring.wide_scores(_decoded(spark, d), LABELS, ["vec_id"])
    writers.write_batch(wide, path, bid)
    writers.write_batch(wide, path, bid)
    return spark.read.parquet(path).select(
        "vec_id", "predicted_label", F.length(F.col("batch_id").cast("string")).alias("id_length"))


@query("score_upload", f"""{_I} SELECT row_id, {duck.strip('title')} AS title, true AS best,
true AS as_in_batch FROM issues WHERE {duck.strip('title')} <> ''""")
def _(spark, d):
    """An upload through the stored scorer, against the same rows scored as a plain batch."""
    rows = _taught_terms(spark, d)
    scorer = _stored_scorer(spark, d, rows)
    df = issues(spark, d)
    out = scoreplan.score_upload(df.select("row_id", "title", "body"), scorer, scorer.labels)
    batch = scorer(rows).select("row_id", F.col("predicted_label").alias("_label"),
                                F.col("confidence").alias("_confidence"))
    shown = F.greatest(*[F.col(f"score_{x}") for x in scorer.labels])
    named = F.coalesce(*[F.when(F.col("predicted_label") == x, F.col(f"score_{x}")) for x in scorer.labels])
    return out.join(batch, "row_id").select(
        "row_id", "title", ((named == shown) & (F.col("confidence_%") == shown)).alias("best"),
        ((F.col("_label") == F.col("predicted_label")) & (F.col("_confidence") == F.col("confidence_%"))
         ).alias("as_in_batch"))


# --- streams: real runs over the landed tables -----------------------------
LANDINGS = 20


def _stream(spark, d, name):
    return streams.table_stream(spark, f"{d}/{name}.parquet", views.table(spark, d, name).schema)


def _log_stream(spark, d):
    return _stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"),
        F.col("value").alias("confidence"))


@query("T01_first_wins_intake", """SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def _(spark, d):
    """Landings in the order of event_id; after each the stream runs until it has no more files."""
    landing, out, checkpoint = (scratch_path(spark, x) for x in ("landing", "intake", "ckpt"))
    events = views.table(spark, d, "events")
    cuts = events.agg(F.percentile_approx("event_id", [i / LANDINGS for i in range(1, LANDINGS)])).first()[0]
    part = sum((F.col("event_id") > c).cast("int") for c in cuts)
    landed = stash(events.withColumn("part", part), "landed")
    for i in range(LANDINGS):
        landed.where(F.col("part") == i).drop("part").write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, events.schema)
        streams.exact_intake(stream, out, checkpoint, "user_id", ["event_id"], buckets=16).awaitTermination()
    return streams.intake_rows(spark, out, events.schema).select("user_id", "event_id")


@query("T02_score_stream", f"""{_SOFT} SELECT predicted_label AS label, 'single' AS source,
count(*) AS n, {duck.mean1('round_even(best * 100, 1)')} AS avg_confidence FROM s GROUP BY 1""")
def _(spark, d):
    out, stream = scratch_path(spark, "scored"), _stream(spark, d, "embeddings")

    def to_log(df):
        rows = df.select("vec_id", _logits().alias("e"))
        return scoring.log_entries(scoring.decode_logits(rows, "e", LABELS), "single",
                                   F.col("vec_id").cast("string"))
    streams.score_stream(stream, out, scratch_path(spark, "ckpt"), to_log).awaitTermination()
    return spark.read.parquet(out).groupBy("label", "source").agg(
        F.count("*").alias("n"), scores.mean1("confidence").alias("avg_confidence"))


@query("T03_running_analytics", f"""SELECT event_type AS label, count(*) AS n,
{duck.mean1('value')} AS avg_confidence FROM events GROUP BY 1""")
def _(spark, d):
    out = scratch_path(spark, "means")
    streams.replace_table(streams.label_means(_log_stream(spark, d)), out,
                          scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out)


_TREND = f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS label,
count(*) AS n, {duck.mean1('value')} AS avg_confidence FROM events GROUP BY ALL"""


@query("T04_confidence_trend", _TREND)
def _(spark, d):
    out = scratch_path(spark, "trend")
    streams.upsert_table(streams.confidence_trend(_log_stream(spark, d), delay="1 hour"), out,
                         scratch_path(spark, "ckpt")).awaitTermination()
    return streams.latest(spark, out, ["window_start", "label"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "label", "n",
        "avg_confidence")


@query("T04_confidence_trend_batch", _TREND)
def _(spark, d):
    return streams.confidence_trend(score_log(spark, d)).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "label", "n",
        "avg_confidence")


@query("T04_late_rows_corrected", f"""WITH t AS ({_TREND}), e AS (SELECT count(*) AS n_all FROM events)
SELECT hour, label, n, avg_confidence, true AS some_late FROM t""")
def _(spark, d):
    """Landings out of order: rows behind the watermark go to a side output and correct the trend."""
    landing, out, checkpoint = (scratch_path(spark, x) for x in ("landing", "trend", "ckpt"))
    log = score_log(spark, d).select("ts", "label", "confidence", (F.pmod("event_id", F.lit(7)) == 3).alias("held"))
    times = log.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    half = F.unix_micros("ts") <= times
    # one row in seven of the first half comes with the second half
    for part in (half & ~F.col("held"), ~half | F.col("held")):
        log.where(part).drop("held").write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, "ts timestamp, label string, confidence double")
        late.intake(stream, out, checkpoint).awaitTermination()
    n_late = late.late_rows(spark, out).count()
    return late.corrected(spark, out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "label", "n", "avg_confidence",
        F.lit(n_late > 0).alias("some_late"))


@query("A07_word_sketches", f"""{_I}, w AS (SELECT {duck.wc('title')} AS t, {duck.wc('body')} AS b FROM issues),
s AS (SELECT 'title' AS "column", avg(t) AS mean_words, min(t) AS min_words, max(t) AS max_words FROM w
  UNION ALL SELECT 'body', avg(b), min(b), max(b) FROM w)
SELECT "column", round(mean_words, 6) AS mean_words, min_words, max_words, true AS median_in_bounds FROM s""")
def _(spark, d):
    """Sketches by parts of the table, merged; the median's rank lies within two hundredths of a half."""
    stats = sketches.WordStats(spark, scratch_path(spark, "word-stats"))
    rows = issues(spark, d).select("row_id", "title", "body")
    for part in range(4):
        stats.add(rows.where(F.pmod("row_id", F.lit(4)) == part), ("title", "body"), f"part{part}")
    stats.add(rows, ("title", "body"), "part0")  # a repeat is not counted
    got = stats.word_stats()
    words = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text.word_count(c).alias("w"))
                                            for c in ("title", "body")])).alias("p")).select("p.*")
    ranks = words.join(got.select("column", "median_words"), "column").groupBy("column").agg(
        F.avg((F.col("w") < F.col("median_words")).cast("int")).alias("below"),
        F.avg((F.col("w") <= F.col("median_words")).cast("int")).alias("upto"))
    return got.join(ranks, "column").select(
        "column", F.round("mean_words", 6).alias("mean_words"), "min_words", "max_words",
        ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_in_bounds"))


@query("analytics_labels", f"""SELECT event_type AS label, count(*) AS n,
{duck.mean1('value')} AS avg_confidence FROM events GROUP BY 1""")
def _(spark, d):
    return scoreplan.analytics(score_log(spark, d))["labels"]


@query("analytics_of_stored_log", f"""SELECT event_type AS label, count(*) AS n,
{duck.mean1('value')} AS avg_confidence, (SELECT count(*) FILTER (user_id % 2 = 0) FROM events) AS single_count,
(SELECT count(*) FILTER (user_id % 2 <> 0) FROM events) AS batch_count FROM events GROUP BY 1""")
def _(spark, d):
    """A log of several commits, one of them repeated: its view is added up from the commits' sums."""
    path = scratch_path(spark, "log")
    log = score_log(spark, d)
    for part in range(3):
        writers.append_log(log.where(F.pmod("event_id", F.lit(3)) == part), path, f"part{part}")
    writers.append_log(log, path, "part1")
    tables = scoreplan.analytics_of_log(spark, path)
    counts = tables["sources"].first()
    return tables["labels"].withColumns({c: F.lit(counts[c]) for c in ("single_count", "batch_count")})
