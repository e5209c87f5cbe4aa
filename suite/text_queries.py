"""Projections, filters, predicates, scalar functions and cleaning chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import cleaning, language, scores, text
from loamsift.operators import gates
from loamsift.session import stash
from suite import duck, views
from suite.registry import query
from suite.views import cte, issues

_I = cte(issues=views.ISSUES)


# --- projections, filters, predicates --------------------------------------
@query("P01_project", f"{_I} SELECT repo, title, body, label FROM issues")
def _(spark, d):
    return issues(spark, d).drop("id").select("repo", "title", "body", "label")


@query("P02_label_filter", f"""{_I} SELECT row_id, lower({duck.strip('label')}) AS label FROM issues
WHERE lower({duck.strip('label')}) IN {duck.names(fixed.LABELS_V3)}""")
def _(spark, d):
    return gates.filter_labels(issues(spark, d), fixed.LABELS_V3).select("row_id", "label")


@query("P03_complete_rows", f"""{_I} SELECT row_id, label FROM (
  SELECT row_id, repo, title, body, lower({duck.strip('label')}) AS label FROM issues)
WHERE {' AND '.join(f"{c} IS NOT NULL AND {duck.strip(c)} <> ''" for c in ('repo', 'title', 'body', 'label'))}
AND label IN {duck.names(fixed.LABELS_FINAL)}""")
def _(spark, d):
    df = issues(spark, d).withColumn("label", gates.normalised_label())
    return gates.complete_rows(df, ("repo", "title", "body", "label"),
                               fixed.LABELS_FINAL).select("row_id", "label")


@query("P04_api_spam", f"""{_I} SELECT row_id FROM issues
WHERE NOT regexp_matches(left(body, 500), {duck.q(duck.SPAM)})""")
def _(spark, d):
    return issues(spark, d).where(~gates.is_api_spam()).select("row_id")


@query("P05_bot_mention", f"""{_I} SELECT row_id FROM issues
WHERE NOT (regexp_matches(title, {duck.q(duck.BOT_MENTION)})
        OR regexp_matches(body, {duck.q(duck.BOT_MENTION)}))""")
def _(spark, d):
    return issues(spark, d).where(~gates.mentions_bot("title", "body")).select("row_id")


@query("P06_bot_author", f"""{_I} SELECT row_id FROM issues
WHERE NOT (regexp_matches(login, {duck.q(duck.BOT_LOGIN)}) OR user_type = 'Bot')""")
def _(spark, d):
    return issues(spark, d).where(
        ~gates.written_by_bot(F.col("login"), F.col("user_type"))).select("row_id")


@query("P07_no_pull_requests", f"{_I} SELECT row_id FROM issues WHERE NOT is_pr")
def _(spark, d):
    nested = issues(spark, d).withColumn(
        "pull_request", F.when(F.col("is_pr"), F.struct(F.lit("u").alias("url"))))
    return nested.where(F.col("pull_request").isNull()).select("row_id")


@query("P08_title_words", f"{_I} SELECT row_id FROM issues WHERE {duck.wc('title')} >= 4")
def _(spark, d):
    return issues(spark, d).where(
        text.word_count("title") >= fixed.COLLECT_TITLE_WORDS).select("row_id")


@query("P09_body_words", f"{_I} SELECT row_id FROM issues WHERE {duck.wc('body')} >= 30")
def _(spark, d):
    return issues(spark, d).where(
        text.word_count("body") >= fixed.COLLECT_BODY_WORDS).select("row_id")


@query("P10_template", f"""WITH base AS ({_I} {duck.STRIPPED})
SELECT row_id FROM base WHERE {duck.template('b')}""")
def _(spark, d):
    return issues(spark, d).where(gates.is_template(text.strip("body"))).select("row_id")


@query("P11_acknowledged", f"""{_I} SELECT row_id FROM issues
WHERE NOT (state = 'open' AND coalesce(comments, 0) < 2)""")
def _(spark, d):
    return issues(spark, d).where(
        ~gates.is_unacknowledged(F.col("state"), F.col("comments"))).select("row_id")


@query("P12_structure", f"""WITH base AS ({_I} {duck.STRIPPED}) SELECT row_id FROM base
WHERE NOT (length(b) < 200 AND NOT contains(b, '.') AND NOT contains(b, chr(10)))""")
def _(spark, d):
    return issues(spark, d).where(~gates.lacks_structure(text.strip("body"))).select("row_id")


def _english(version, test):
    @query(f"P13{'abc'[('collect', 'v3', 'final').index(version)]}_english_{version}",
           f"{_I} SELECT row_id, {duck.english('title', 'body', version)} AS english FROM issues")
    def run(spark, d):
        return issues(spark, d).select(
            "row_id", language.is_english("title", "body", test).alias("english"))
    return run


_english("collect", language.COLLECT)
_english("v3", language.V3)
_english("final", language.FINAL)


@query("P14_quality_gate",
       f"WITH base AS ({_I} {duck.STRIPPED}) SELECT row_id, {duck.REASON} AS reason FROM base")
def _(spark, d):
    return issues(spark, d).select("row_id", gates.rejection_reason().alias("reason"))


@query("P15_repo_eligible", f"""{cte(repos=views.REPOS)} SELECT full_name, stars, issues FROM repos
WHERE stars >= 300 AND issues >= 30 AND NOT archived AND NOT disabled
AND NOT coalesce(fork, false)""")
def _(spark, d):
    return views.repos(spark, d).where(gates.eligible_repo()).select("full_name", "stars", "issues")


@query("P16_closed_only", f"{_I} SELECT row_id FROM issues WHERE state = 'closed'")
def _(spark, d):
    return issues(spark, d).where("state = 'closed'").select("row_id")


_UPLOAD = """SELECT row_id, CASE WHEN comments = 3 THEN '  ' ELSE title END AS title,
  CASE WHEN state = 'open' THEN NULL ELSE body END AS body FROM issues"""


@query("P17_upload_rows", f"""WITH up AS ({_I} {_UPLOAD})
SELECT row_id, {duck.strip('title')} AS title, coalesce(body, '') AS body FROM up
WHERE {duck.strip('title')} <> ''""")
def _(spark, d):
    up = issues(spark, d).selectExpr(
        "row_id", "CASE WHEN comments = 3 THEN '  ' ELSE title END AS title",
        "CASE WHEN state = 'open' THEN NULL ELSE body END AS body")
    return gates.valid_upload_rows(up)


@query("P18_batch_guard", f"""{_I}, u AS (SELECT count(*) AS n FROM issues
WHERE {duck.strip('title')} <> '') SELECT 'within' AS case, n FROM u
UNION ALL SELECT 'above', 0 FROM u WHERE n > 0 UNION ALL SELECT 'empty', 0""")
def _(spark, d):
    """All rows pass a limit of their number; a limit one below and an empty batch are refused."""
    rows = gates.valid_upload_rows(issues(spark, d))
    n = rows.count()
    out = gates.guard_batch(rows, n).agg(F.count("*").alias("n")).select(F.lit("within").alias("case"), "n")
    for case, batch, limit in (("above", rows, n - 1), ("empty", rows.where("false"), n)):
        try:
            gates.guard_batch(batch, limit)
        except ValueError:
            out = out.unionByName(spark.range(1).select(
                F.lit(case).alias("case"), F.lit(0).cast("long").alias("n")))
    return out


@query("P19_emit_record", f"""{_I} SELECT id, repo, {duck.strip('title')} AS title,
left({duck.strip('body')}, 10000) AS body, lower({duck.strip('label')}) AS label FROM issues""")
def _(spark, d):
    return gates.emit_record(issues(spark, d).withColumn("label", gates.normalised_label()))


# --- generic scalar functions ----------------------------------------------
@query("F01_nfkc", "SELECT doc_id, text || ' fix 12 ABC' AS nfkc FROM documents")
def _(spark, d):
    """Text whose letters a, e and n are full-width and that ends in a ligature."""
    wide = F.concat(F.translate("text", "aenAEN", "\uff41\uff45\uff4e\uff21\uff25\uff2e"),
                    F.lit(" \ufb01x \uff11\uff12 \uff21\uff22\uff23"))
    return views.documents(spark, d).withColumn("wide", wide).select(
        "doc_id", text.nfkc("wide").alias("nfkc"))


@query("F02_strip", f"{_I} SELECT row_id, {duck.strip('label')} AS label, {duck.strip('body')} AS body FROM issues")
def _(spark, d):
    return issues(spark, d).select("row_id", text.strip("label").alias("label"),
                                   text.strip("body").alias("body"))


@query("F03_lower", f"{_I} SELECT row_id, lower(body) AS body FROM issues")
def _(spark, d):
    return issues(spark, d).select("row_id", F.lower("body").alias("body"))


@query("F04_prefix", "SELECT doc_id, left(text, 400) AS a, left(text, 10000) AS b FROM documents")
def _(spark, d):
    return views.documents(spark, d).select(
        "doc_id", text.prefix("text", 400).alias("a"), text.prefix("text", 10_000).alias("b"))


@query("F05_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(spark, d):
    return views.documents(spark, d).select("doc_id", F.length("text").cast("long").alias("n"))


@query("F06_split_words", r"""SELECT w AS word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY w""")
def _(spark, d):
    return (views.documents(spark, d).select(F.explode(text.words("text")).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")))


@query("F07_word_count", f"{_I} SELECT row_id, {duck.wc('title')} AS t, {duck.wc('body')} AS b FROM issues")
def _(spark, d):
    return issues(spark, d).select(
        "row_id", text.word_count("title").cast("long").alias("t"),
        text.word_count("body").cast("long").alias("b"))


@query("F08_head_words", f"""WITH base AS ({_I} {duck.STRIPPED})
SELECT row_id, {duck.head('b', 350)} AS v3, {duck.head('b', 280)} AS final FROM base""")
def _(spark, d):
    df = issues(spark, d).select("row_id", text.strip("body").alias("b"))
    return df.select("row_id", text.head_words("b", 350).alias("v3"),
                     text.head_words("b", 280).alias("final"))


@query("F09_contains", f"""{_I} SELECT row_id, contains(body, '.') AS dot,
contains(body, chr(10)) AS newline FROM issues""")
def _(spark, d):
    return issues(spark, d).select("row_id", F.contains("body", F.lit(".")).alias("dot"),
                                   F.contains("body", F.lit("\n")).alias("newline"))


@query("F10_regex", rf"""{_I} SELECT row_id, regexp_matches(body, '#\d+') AS hit,
CAST(len(regexp_extract_all(body, '\d+')) AS BIGINT) AS numbers,
regexp_replace(body, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g') AS linked FROM issues""")
def _(spark, d):
    from loamsift.functions.regex import java
    return issues(spark, d).select(
        "row_id", F.col("body").rlike(java(fixed.ISSUE_REF)).alias("hit"),
        F.regexp_count("body", F.lit(java(r"\d+"))).cast("long").alias("numbers"),
        F.regexp_replace("body", fixed.MD_LINK, "$1").alias("linked"))


@query("F11_code_points", r"""SELECT doc_id,
CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS BIGINT) AS cjk,
CAST(len(regexp_extract_all(text, '[\x{0400}-\x{04ff}]')) AS BIGINT) AS cyrillic,
CAST(len(regexp_extract_all(text, '[^\x00-\x7F]')) AS BIGINT) AS non_ascii FROM documents""")
def _(spark, d):
    def n(pattern):
        return F.regexp_count("text", F.lit(pattern)).cast("long")
    return views.documents(spark, d).select(
        "doc_id", n(language.SCRIPT_BLOCKS[0]).alias("cjk"),
        n(language.SCRIPT_BLOCKS[2]).alias("cyrillic"), n(text.NON_ASCII).alias("non_ascii"))


@query("F12_null_default", f"{_I} SELECT row_id, coalesce(comments, 0) AS comments FROM issues")
def _(spark, d):
    return issues(spark, d).select("row_id", F.coalesce("comments", F.lit(0)).alias("comments"))


@query("F13_clamp", f"""{cte(repos=views.REPOS)} SELECT full_name, p_partkey,
CAST(least(53, greatest(20, issues // 5)) AS BIGINT) AS cap FROM repos""")
def _(spark, d):
    cap = F.least(F.lit(53), F.greatest(F.lit(20), F.floor(F.col("issues") / 5)))
    return views.repos(spark, d).select("full_name", "p_partkey", cap.cast("long").alias("cap"))


@query("F14_round_half_even",
       "SELECT event_id, round_even(value * 0.25, 1) AS r FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select(
        "event_id", scores.round1(F.col("value") * 0.25).alias("r"))


@query("F19_formatting", f"""{cte(repos=views.REPOS)} SELECT p_partkey, format('{{:,}}', stars) AS stars,
printf('%.1f', issues * 0.5) || '%' AS pct FROM repos""")
def _(spark, d):
    return views.repos(spark, d).select(
        "p_partkey", scores.thousands(F.col("stars")).alias("stars"),
        scores.percent_text(F.col("issues") * 0.5).alias("pct"))


@query("F20_iso_timestamp", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS iso
FROM events""")
def _(spark, d):
    return views.table(spark, d, "events").select(
        "event_id", scores.iso_timestamp(F.col("ts")).alias("iso"))


@query("F21_suffix", "SELECT page_id, ends_with(lower(url), '.html') AS html FROM pages")
def _(spark, d):
    return views.table(spark, d, "pages").select(
        "page_id", F.endswith(F.lower("url"), F.lit(".html")).alias("html"))


@query("F22_owner_repo", f"""{cte(repos=views.REPOS)} SELECT p_partkey,
split_part(full_name, '/', 1) AS owner,
substr(full_name, strpos(full_name, '/') + 1) AS repo FROM repos""")
def _(spark, d):
    parts = F.split("full_name", "/", 2)
    return views.repos(spark, d).select("p_partkey", parts[0].alias("owner"), parts[1].alias("repo"))


@query("F23_batch_id", f"{_I} SELECT repo, count(*) AS n, true AS well_formed, true AS differs FROM issues GROUP BY repo")
def _(spark, d):
    """One id per repo's batch: eight hex digits, different from the ids of all other batches."""
    batches = stash(issues(spark, d).groupBy("repo").agg(F.count("*").alias("n")).withColumn(
        "b", scores.batch_id()), "batches")
    shared = batches.groupBy("b").agg(F.count("*").alias("times"))
    return batches.join(shared, "b").select(
        "repo", "n", F.col("b").rlike("^[0-9a-f]{8}$").alias("well_formed"),
        (F.col("times") == 1).alias("differs"))


@query("F24_parse_spec", f"""{cte(repos=views.REPOS)} SELECT p_partkey, language, topic1 AS topic,
stars AS min_stars FROM repos""")
def _(spark, d):
    from loamsift.operators.discovery import parse_spec
    spec = F.concat(F.coalesce(F.concat(F.lit("language:"), "language", F.lit(" ")), F.lit("")),
                    F.lit("stars:>"), F.col("stars").cast("string"), F.lit(" topic:"), "topic1")
    return views.repos(spark, d).withColumn("spec", spec).select(
        "p_partkey", *[c.alias(n) for n, c in parse_spec(F.col("spec")).items()])


@query("U03_token_overlap", f"""SELECT doc_id, CAST(len(list_intersect(list_distinct(
regexp_extract_all(lower(text), '\\S+')), [{', '.join(duck.q(w) for w in fixed.STOP_WORDS_FINAL)}]))
AS BIGINT) AS hits FROM documents""")
def _(spark, d):
    return views.documents(spark, d).select(
        "doc_id", text.distinct_hits("text", fixed.STOP_WORDS_FINAL).cast("long").alias("hits"))


# --- cleaning chains -------------------------------------------------------
def _clean(qid, version, column, cleaner):
    sql = f"WITH base AS ({_I} {duck.cleaned(version)}) SELECT row_id, {column} FROM base"

    @query(f"{qid}_clean_{column}_{version}", sql)
    def run(spark, d):
        df = issues(spark, d).select("row_id", column)
        return cleaning.clean(df, {column: cleaner})
    return run


_clean("C01", "v3", "title", cleaning.TITLE_V3)
_clean("C02", "final", "title", cleaning.TITLE_FINAL)
_clean("C03", "v3", "body", cleaning.BODY_V3)
_clean("C04", "final", "body", cleaning.BODY_FINAL)


def _steps(name, cleaner, rules, steps):
    @query(name, f"SELECT page_id, {duck.chain('html', steps)} AS html FROM pages")
    def run(spark, d):
        pages = views.table(spark, d, "pages")
        c = F.col("html")
        for rule in rules:
            c = cleaning.rule_named(cleaner, rule).apply(c)
        return pages.select("page_id", c.alias("html"))
    return run


_COMMENT = (r"<!--[\s\S]*?-->", " ")
_steps("C03_html_steps", cleaning.BODY_V3, ("html_comment", "html_tag", "entity"),
       [_COMMENT, (duck.TAG, " "), (duck.ENTITY, " ")])
_steps("C04_url_steps", cleaning.BODY_FINAL, ("html_comment", "url", "issue_ref", "spaces"),
       [_COMMENT, (duck.URL, " "), (r"#\d+", " "), (r"[ \t]+", " ")])


@query("C04_clean_pages", f"""WITH base AS ({duck.cleaned('final', "(SELECT page_id, url AS title, html AS body FROM pages)")})
SELECT page_id, title, body FROM base""")
def _(spark, d):
    pages = views.table(spark, d, "pages")
    df = pages.select("page_id", F.col("url").alias("title"), F.col("html").alias("body"))
    return cleaning.clean(df, {"title": cleaning.TITLE_FINAL, "body": cleaning.BODY_FINAL})


