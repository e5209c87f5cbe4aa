"""Joins, aggregations, dedup, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import scores, text
from loamsift.operators import discovery, gates, ranking, summary
from loamsift.session import scratch_path, stash
from loamsift.sources.seen import SeenStore
from suite import duck, views
from suite.registry import query
from suite.views import cte, issues, repo_dim, repos, score_log, tickets

_I = cte(issues=views.ISSUES)
_T = cte(tickets=views.TICKETS)
_LOG = cte(log=views.SCORE_LOG)

ALIASES = ", ".join(
    f"({duck.q(label)}, {fixed.LABELS_COLLECT.index(label)}, {duck.q(alias)}, {i})"
    for label, names in fixed.LABEL_ALIASES.items() for i, alias in enumerate(names))
ALIAS_DIM = f"SELECT * FROM (VALUES {ALIASES}) AS t(label, label_rank, alias, alias_rank)"


def _spec_rows() -> str:
    rows = []
    for i, spec in enumerate(fixed.DISCOVERY_SPECS, 1):
        part = dict(p.split(":", 1) for p in spec.split(" "))
        rows.append(f"({i}, {duck.q(part['language']) if 'language' in part else 'NULL'}, "
                    f"{duck.q(part['topic']) if 'topic' in part else 'NULL'}, "
                    f"{part['stars'].lstrip('>')})")
    return ", ".join(rows)


SPEC_DIM = f"SELECT * FROM (VALUES {_spec_rows()}) AS t(spec_id, spec_language, topic, min_stars)"
MATCHES = """SELECT s.spec_id, r.* FROM repos r JOIN specs s
  ON (s.spec_language IS NULL OR s.spec_language = r.language)
 AND (s.topic IS NULL OR s.topic = r.topic1 OR s.topic = r.topic2) AND r.stars > s.min_stars"""
PAGES = """SELECT * FROM matches
  QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY stars DESC, full_name) <= 90"""
FIRST_MATCH = """SELECT * FROM pages WHERE stars >= 300 AND issues >= 30 AND NOT archived
  AND NOT disabled AND NOT coalesce(fork, false)
  QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY spec_id, stars DESC) = 1"""
CHOSEN = """SELECT full_name, stars, coalesce(language, '') AS language, issues FROM first_match
  ORDER BY stars DESC, full_name LIMIT 600"""
DISCOVERY = dict(repos=views.REPOS, specs=SPEC_DIM, matches=MATCHES, pages=PAGES,
                 first_match=FIRST_MATCH)
EXPLODED = """SELECT t.*, a.label AS canonical, a.label_rank, a.alias_rank, a.alias FROM
  (SELECT *, unnest([alias1, alias2]) AS al FROM tickets) t JOIN aliases a ON a.alias = t.al"""


def _exploded(spark, d):
    df = tickets(spark, d).drop("label")
    return discovery.resolve_aliases(df, discovery.alias_dim(spark))


# --- joins -----------------------------------------------------------------
@query("J01_alias_to_label", f"""{cte(tickets=views.TICKETS, aliases=ALIAS_DIM, x=EXPLODED)}
SELECT id, alias, canonical AS label FROM x""")
def _(spark, d):
    return _exploded(spark, d).select("id", "alias", "label")


@query("J02_issues_of_repos", f"""{cte(tickets=views.TICKETS, dim=views.REPO_DIM)}
SELECT t.id, t.repo, r.stars, CAST(r.issues AS BIGINT) AS issues
FROM tickets t JOIN dim r ON r.full_name = t.repo""")
def _(spark, d):
    # one row per nation key, but no bound is proven here: Spark picks the join
    return discovery.of_repos(tickets(spark, d), repo_dim(spark, d)).select(
        "id", "repo", "stars", "issues")


@query("J03_repos_to_specs", f"""{cte(repos=views.REPOS, specs=SPEC_DIM, matches=MATCHES)}
SELECT spec_id, full_name, stars FROM matches""")
def _(spark, d):
    return discovery.match_specs(repos(spark, d), discovery.spec_dim(spark)).select(
        "spec_id", "full_name", "stars")


@query("J04_skip_seen", f"""{cte(tickets=views.TICKETS, seen=views.SEEN)}
SELECT id, repo FROM tickets WHERE id NOT IN (SELECT id FROM seen)""")
def _(spark, d):
    return discovery.not_seen(tickets(spark, d), views.seen_ids(spark, d)).select("id", "repo")


@query("J04_skip_seen_stored", f"""{cte(tickets=views.TICKETS, seen=views.SEEN)}
SELECT id, repo FROM tickets WHERE id NOT IN (SELECT id FROM seen)""")
def _(spark, d):
    """The seen ids stored by several runs behind filters; only folders with possible hits are read."""
    store = SeenStore(spark, scratch_path(spark, "seen"), "id", "long", buckets=16)
    seen = views.seen_ids(spark, d)
    for run in range(3):  # each run knows a part again
        store.add(seen.where(F.pmod("id", F.lit(4)) >= run), ["id"], f"run{run}")
    store.add(seen, ["id"], "last")
    return store.unseen(tickets(spark, d).select("id", "repo"))


@query("J05_skip_done", f"""{cte(tickets=views.TICKETS, done=views.DONE)}
SELECT id, t.label, t.repo FROM tickets t
ANTI JOIN done d ON d.label = t.label AND d.repo = t.repo""")
def _(spark, d):
    return discovery.not_done(tickets(spark, d), views.done_pairs(spark, d)).select(
        "id", "label", "repo")


@query("J06_known_labels", f"""{_I} SELECT row_id FROM (
  SELECT row_id, lower({duck.strip('label')}) AS label FROM issues)
WHERE label IN {duck.names(fixed.LABELS_FINAL)}""")
def _(spark, d):
    known = F.broadcast(discovery.label_dim(spark, fixed.LABELS_FINAL))
    return issues(spark, d).withColumn("label", gates.normalised_label()).join(
        known, "label", "left_semi").select("row_id")


_COLORS = " ".join(f"WHEN {duck.q(x)} THEN {duck.q(fixed.PALETTE[i])}"
                   for i, x in enumerate(fixed.LABELS_MODEL))
_IDS = " ".join(f"WHEN {duck.q(x)} THEN {i}" for i, x in enumerate(fixed.LABELS_MODEL))


@query("J07_label_colors", f"""{_I}, l AS (SELECT row_id, lower({duck.strip('label')}) AS label FROM issues)
SELECT row_id, label, CASE label {_IDS} ELSE -1 END AS label_id,
CASE label {_COLORS} ELSE '#888' END AS color FROM l""")
def _(spark, d):
    ids = {x: i for i, x in enumerate(fixed.LABELS_MODEL)}
    label = F.col("label")
    return issues(spark, d).select("row_id", gates.normalised_label().alias("label")).select(
        "row_id", "label", F.coalesce(scores.encode_label(label, ids), F.lit(-1)).alias("label_id"),
        scores.label_color(label, fixed.LABELS_MODEL).alias("color"))


_HAVE = f"""{_I}, have AS (SELECT lower({duck.strip('label')}) AS label, count(*) AS n
  FROM issues GROUP BY 1),
gap AS (SELECT v.label, coalesce(h.n, 0) AS have, greatest(10000 - coalesce(h.n, 0), 0) AS needed
  FROM (VALUES {', '.join(f'({duck.q(x)})' for x in fixed.LABELS_COLLECT)}) v(label)
  LEFT JOIN have h ON h.label = v.label)"""


def _have(spark, d):
    return summary.count_by(
        issues(spark, d).withColumn("label", gates.normalised_label()), "label")


@query("J08_label_gap", f"{_HAVE} SELECT label, have, needed FROM gap")
def _(spark, d):
    return summary.shortfall(_have(spark, d), discovery.label_dim(spark), fixed.TARGET_PER_LABEL)


@query("J09_results_on_rows", """SELECT vec_id, label, CAST(list_position(e, list_max(e)) - 1 AS INT)
AS predicted FROM (SELECT vec_id, label, embedding AS e FROM embeddings)""")
def _(spark, d):
    return views.table(spark, d, "embeddings").withColumn(
        "predicted", scores.argmax(F.col("embedding")).cast("int")).select(
        "vec_id", "label", "predicted")


# --- aggregations ----------------------------------------------------------
@query("A01_count_per_label", f"""{_I} SELECT lower({duck.strip('label')}) AS label, count(*) AS n
FROM issues GROUP BY 1""")
def _(spark, d):
    return _have(spark, d)


@query("A02_class_shares", """SELECT event_type AS label, n, round_even(100.0 * n / t, 1) AS pct,
repeat('█', CAST(floor(100.0 * n / t / 2) AS INT)) AS bar FROM (
  SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)""")
def _(spark, d):
    return summary.class_shares(score_log(spark, d))


@query("A03_top_repos", f"""{_T} SELECT repo, count(*) AS n FROM tickets
GROUP BY repo ORDER BY n DESC, repo LIMIT 10""")
def _(spark, d):
    return summary.top_counts(tickets(spark, d))


@query("A04_mean_confidence",
       f"SELECT {duck.mean1('value')} AS avg_confidence FROM events")
def _(spark, d):
    return summary.mean_confidence(score_log(spark, d))


@query("A05_mean_confidence_per_label", f"""SELECT event_type AS label,
{duck.mean1('value')} AS avg_confidence FROM events GROUP BY 1""")
def _(spark, d):
    return summary.mean_confidence(score_log(spark, d), "label")


@query("A06_source_counts", f"""{_LOG} SELECT count(*) AS total,
count(*) FILTER (source = 'single') AS single_count,
count(*) FILTER (source = 'batch') AS batch_count FROM log""")
def _(spark, d):
    return summary.source_counts(score_log(spark, d))


@query("A07_word_stats", f"""{_I}, w AS (
  SELECT 'title' AS "column", {duck.wc('title')} AS n FROM issues UNION ALL
  SELECT 'body', {duck.wc('body')} FROM issues)
SELECT "column", round(avg(n), 6) AS mean_words, CAST(median(n) AS DOUBLE) AS median_words,
min(n) AS min_words, max(n) AS max_words FROM w GROUP BY 1""")
def _(spark, d):
    return summary.word_stats(issues(spark, d), "title", "body").withColumn(
        "mean_words", F.round("mean_words", 6))


@query("A08_balance_ratio", f"""{_I} SELECT round(max(n) / min(n), 6) AS balance_ratio FROM (
  SELECT lower({duck.strip('label')}) AS label, count(*) AS n FROM issues GROUP BY 1)""")
def _(spark, d):
    df = issues(spark, d).withColumn("label", gates.normalised_label())
    return summary.balance_ratio(df).select(F.round("balance_ratio", 6).alias("balance_ratio"))


@query("A09_cell_audit", f"""{_I} SELECT
count(*) FILTER (comments IS NULL) + count(*) FILTER (body IS NULL) AS nulls,
count(*) FILTER (t = '') + count(*) FILTER (body = '') AS empties FROM (
  SELECT comments, body, CASE WHEN comments = 2 THEN '' ELSE title END AS t FROM issues)""")
def _(spark, d):
    return summary.cell_audit(issues(spark, d).selectExpr(
        "comments", "body", "CASE WHEN comments = 2 THEN '' ELSE title END AS t"))


@query("A10_placeholder_leak", rf"""{_I} SELECT CAST(sum(len(regexp_extract_all(body,
'\[(CODE|URL|VERSION|FILEPATH|HASH)\]'))) AS BIGINT) AS placeholders FROM issues""")
def _(spark, d):
    return summary.placeholder_leak(issues(spark, d))


@query("A12_reason_histogram", f"""WITH base AS ({_I} {duck.STRIPPED})
SELECT coalesce({duck.REASON}, 'passed') AS reason, count(*) AS n FROM base GROUP BY 1""")
def _(spark, d):
    return summary.reason_histogram(
        issues(spark, d).select(gates.rejection_reason().alias("reason")))


@query("A13_rare_labels", f"{_HAVE} SELECT label, have, needed FROM gap WHERE have < 7000")
def _(spark, d):
    return summary.rare_labels(_have(spark, d), discovery.label_dim(spark),
                               fixed.TARGET_PER_LABEL)


@query("A13_rare_labels_some_above", f"""{_HAVE} SELECT label, have, 200 - have AS needed FROM gap
WHERE have < 200""")
def _(spark, d):
    return summary.rare_labels(_have(spark, d), discovery.label_dim(spark), 200)


@query("A14_star_range", f"""{cte(**DISCOVERY, chosen=CHOSEN)}
SELECT min(stars) AS min_stars, max(stars) AS max_stars FROM chosen""")
def _(spark, d):
    from loamsift.plans.collect import choose_repos
    return summary.star_range(choose_repos(repos(spark, d), discovery.spec_dim(spark)))


# --- dedup -----------------------------------------------------------------
_FIRST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY row_id) = 1"


@query("D01_dedup_title_body",
       f"{_I} SELECT row_id, title, body FROM issues {_FIRST.format('title, body')}")
def _(spark, d):
    return ranking.dedup_title_body(issues(spark, d)).select("row_id", "title", "body")


@query("D02_dedup_title_then_body", f"""{_I},
l AS (SELECT row_id, title, body, lower({duck.strip('label')}) AS label FROM issues),
a AS (SELECT * FROM l {_FIRST.format('title, label')})
SELECT row_id, label FROM a {_FIRST.format('body, label')}""")
def _(spark, d):
    df = issues(spark, d).withColumn("label", gates.normalised_label())
    return ranking.dedup_title_then_body(df).select("row_id", "label")


@query("D03_first_per_id", f"""{cte(tickets=views.TICKETS, aliases=ALIAS_DIM, x=EXPLODED)}
SELECT id, canonical AS label, alias FROM x QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY label_rank, alias_rank, updated_at DESC) = 1""")
def _(spark, d):
    return discovery.first_per_id(_exploded(spark, d)).select("id", "label", "alias")


@query("D04_first_per_repo",
       f"{cte(**DISCOVERY)} SELECT full_name, spec_id, stars FROM first_match")
def _(spark, d):
    pages = discovery.pages_per_spec(discovery.match_specs(repos(spark, d),
                                                           discovery.spec_dim(spark)))
    return discovery.first_match_per_repo(pages.where(gates.eligible_repo())).select(
        "full_name", "spec_id", "stars")


# --- windows, top-k, order -------------------------------------------------
def _cap(name, cap, labels):
    wc = duck.wc("body")

    @query(name, f"""{_I}, l AS (SELECT row_id, body, lower({duck.strip('label')}) AS label FROM issues)
SELECT row_id, label FROM l WHERE label IN {duck.names(labels)}
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {wc} DESC, row_id) <= {cap}""")
    def run(spark, d):
        df = issues(spark, d).withColumn("label", gates.normalised_label())
        return ranking.cap_per_label(df, cap, labels, text.word_count("body")).select(
            "row_id", "label")
    return run


# The production caps, and a small one that bites on the given tables.
_cap("W01_cap_v3", fixed.V3_CAP, fixed.LABELS_V3)
_cap("W01_cap_of_100", 100, fixed.LABELS_V3)
_cap("W02_cap_final", fixed.FINAL_CAP, fixed.LABELS_FINAL)
_cap("W02_cap_of_60", 60, fixed.LABELS_FINAL)

_WITH_REPO = """SELECT x.*, r.stars, r.issues FROM x JOIN dim r ON r.full_name = x.repo"""
_COLLECT_VIEWS = dict(tickets=views.TICKETS, dim=views.REPO_DIM, aliases=ALIAS_DIM, x=EXPLODED,
                      rows=_WITH_REPO)
_UNIQUE = """SELECT * FROM rows QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY label_rank, alias_rank, updated_at DESC, repo) = 1"""
_CAPPED = """SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY repo, canonical
  ORDER BY alias_rank, updated_at DESC, id) <= least(36, greatest(20, issues // 5))"""


def _unique(spark, d):
    rows = discovery.of_repos(_exploded(spark, d), repo_dim(spark, d))
    return discovery.first_per_id(rows)


@query("W03_cap_per_repo_label", f"""{cte(**_COLLECT_VIEWS, uniq=_UNIQUE, capped=_CAPPED)}
SELECT id, repo, canonical AS label FROM capped""")
def _(spark, d):
    return discovery.cap_per_repo_label(_unique(spark, d), 200, 25).select("id", "repo", "label")


@query("W04_pages_per_alias", f"""{cte(tickets=views.TICKETS, aliases=ALIAS_DIM, x=EXPLODED)}
SELECT id, repo, alias FROM x QUALIFY row_number() OVER (
  PARTITION BY repo, alias ORDER BY updated_at DESC, id) <= 1000""")
def _(spark, d):
    return discovery.pages_per_alias(_exploded(spark, d)).select("id", "repo", "alias")


@query("W04_pages_of_40", f"""{cte(tickets=views.TICKETS, aliases=ALIAS_DIM, x=EXPLODED)}
SELECT id, repo, alias FROM x QUALIFY row_number() OVER (
  PARTITION BY repo, alias ORDER BY updated_at DESC, id) <= 40""")
def _(spark, d):
    return discovery.pages_per_alias(_exploded(spark, d).select(
        "id", "repo", "alias", "updated_at"), 40).select("id", "repo", "alias")


@query("W05_pages_per_spec", f"""{cte(repos=views.REPOS, specs=SPEC_DIM, matches=MATCHES, pages=PAGES)}
SELECT spec_id, full_name, stars FROM pages""")
def _(spark, d):
    return discovery.pages_per_spec(discovery.match_specs(
        repos(spark, d), discovery.spec_dim(spark))).select("spec_id", "full_name", "stars")


@query("W06_label_quota", f"""{cte(**_COLLECT_VIEWS, uniq=_UNIQUE, capped=_CAPPED)},
n AS (SELECT canonical AS label, repo, stars, count(*) AS n FROM capped GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY stars DESC, repo
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT c.id, b.label, b.repo FROM capped c JOIN b ON b.label = c.canonical AND b.repo = c.repo
WHERE b.before < 200""")
def _(spark, d):
    capped = stash(discovery.cap_per_repo_label(_unique(spark, d).select(
        "id", "label", "repo", "alias_rank", "updated_at", "stars", "issues"), 200, 25), "capped")
    counts = capped.groupBy("label", "repo", "stars").agg(F.count("*").alias("n"))
    taken = ranking.within_quota(counts, 200)
    return capped.join(taken, ["label", "repo"], "left_semi").select("id", "label", "repo")


@query("W07_timeline", f"""{_LOG} SELECT event_id, label, confidence FROM log
ORDER BY ts DESC, event_id DESC LIMIT 120""")
def _(spark, d):
    return summary.timeline(score_log(spark, d), tie=("event_id",)).select("event_id", "label", "confidence")


@query("W08_top_repos", f"{cte(**DISCOVERY, chosen=CHOSEN)} SELECT * FROM chosen")
def _(spark, d):
    from loamsift.plans.collect import choose_repos
    return choose_repos(repos(spark, d), discovery.spec_dim(spark)).withColumn(
        "language", F.coalesce("language", F.lit("")))


@query("O01_sort", f"{_T} SELECT id, size FROM tickets ORDER BY size DESC, id")
def _(spark, d):
    return tickets(spark, d).select("id", "size").orderBy(F.desc("size"), "id")


@query("O02_shuffle", f"""{_I}, n AS (SELECT count(*) AS n FROM issues)
SELECT row_id, title, true AS hash_order, n > 1 AS moved FROM issues, n""")
def _(spark, d):
    """The stored order is that of the seeded hash, and most rows have left their places."""
    out = ranking.shuffled(issues(spark, d).select("row_id", "title"), fixed.SHUFFLE_SEED)
    # positions in the order in which tasks write: ranges first, then rows inside each
    stored = stash(out.withColumn("at", F.monotonically_increasing_id()), "shuffled")
    placed = ranking.dense_index(stored, "at", "place").withColumn(
        "hashed", F.xxhash64("row_id", F.lit(fixed.SHUFFLE_SEED)))
    placed = ranking.dense_index(ranking.dense_index(placed, "hashed", "hash_place"), "row_id", "old_place")
    stay, n = placed.agg(F.count_if(F.col("place") == F.col("old_place")), F.count("*")).first()
    return placed.select("row_id", "title", (F.col("place") == F.col("hash_place")).alias("hash_order"),
                         F.lit(2 * stay < n).alias("moved"))


@query("O03_dense_index", f"""{_T} SELECT id, row_number() OVER (ORDER BY id) - 1 AS index
FROM tickets WHERE state = 'closed'""")
def _(spark, d):
    return ranking.dense_index(tickets(spark, d).where("state = 'closed'").select("id"), "id")


# --- set operations --------------------------------------------------------
@query("U01_per_label_slices", f"""{_T} SELECT id, label FROM tickets
WHERE label IN {duck.names(fixed.LABELS_FINAL)}
QUALIFY row_number() OVER (PARTITION BY label ORDER BY size DESC, id) <= 50""")
def _(spark, d):
    df = tickets(spark, d).select("id", "label", "size").where(
        F.col("label").isin(*fixed.LABELS_FINAL))
    return ranking.top_per_group(df, ["label"], [F.desc("size"), "id"], 50).select("id", "label")


@query("U02_append_rows", f"""{cte(tickets=views.TICKETS, seen=views.SEEN)}
SELECT id, label FROM tickets WHERE id IN (SELECT id FROM seen)
UNION ALL SELECT id, label FROM tickets WHERE id NOT IN (SELECT id FROM seen)""")
def _(spark, d):
    seen, all_rows = views.seen_ids(spark, d), tickets(spark, d).select("id", "label")
    return all_rows.join(seen, "id", "left_semi").unionByName(discovery.not_seen(all_rows, seen))
