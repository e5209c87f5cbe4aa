"""Views over the given tables, written once as SQL that Spark and DuckDB accept.

``{table}`` is a DataFrame in Spark and the table itself in DuckDB. Issue text is
decorated by ``length(text)`` only, so copies of a text stay copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.session import spread

_NL = "chr(10)"

ISSUE_COLUMNS = {
    "id": "doc_id",
    "row_id": "doc_id",
    "repo": "source",
    "label": """CASE WHEN doc_id % 11 = 0 THEN '  BUG ' ELSE
    CASE doc_id % 7 WHEN 0 THEN 'bug' WHEN 1 THEN 'enhancement' WHEN 2 THEN 'documentation'
      WHEN 3 THEN 'question' WHEN 4 THEN 'performance' WHEN 5 THEN 'refactor' ELSE 'wontfix' END
  END""",
    "title": f"""CASE length(text) % 5 WHEN 0 THEN '[BUG] ' WHEN 1 THEN '(fix) ' WHEN 2 THEN 'codecov #12 '
    WHEN 3 THEN '&amp; ' ELSE '' END || replace(left(text, 60), {_NL}, ' ')""",
    "body": f"""CASE length(text) % 10
    WHEN 0 THEN '## Steps to reproduce' || {_NL} || text
    WHEN 1 THEN '<!-- hidden note -->' || chr(13) || {_NL} || text || {_NL} || '- [x] done'
      || {_NL} || '- item'
    WHEN 2 THEN text || {_NL} || '```' || {_NL} || 'x = 1' || {_NL} || '```' || {_NL}
      || 'call `run()` now'
    WHEN 3 THEN 'see [docs](https://a.example.com/b) v1.2.3 ' || text || ' #42 deadbeef01'
    WHEN 4 THEN text || {_NL} || 'Traceback (most recent call last)' || {_NL} || '  File x, line 1'
      || {_NL} || 'ValueError: bad' || {_NL} || {_NL} || 'after'
    WHEN 5 THEN '| a | b |' || {_NL} || '> quoted' || {_NL} || '---' || {_NL} || text
      || ' **bold** ~~gone~~ wow!!!!'
    WHEN 6 THEN '2024-01-02 03:04 INFO start' || {_NL} || text
      || ' [CODE] [URL] [stacktrace] <b>x</b> &nbsp;'
    WHEN 7 THEN '**API Name**: x' || {_NL} || text
    WHEN 8 THEN 'fails with code ' || CAST(length(text) AS STRING) || {_NL} || text
    ELSE text END""",
    "login": """CASE WHEN doc_id % 23 = 0 THEN 'dependabot[bot]'
    ELSE 'user' || CAST(doc_id % 97 AS STRING) END""",
    "user_type": "CASE WHEN doc_id % 31 = 0 THEN 'Bot' ELSE 'User' END",
    "state": "CASE WHEN doc_id % 5 = 0 THEN 'open' ELSE 'closed' END",
    "comments": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 4 END",
    "is_pr": "doc_id % 17 = 0",
    "alias1": """CASE doc_id % 7 WHEN 0 THEN 'kind/bug' WHEN 1 THEN 'feature' WHEN 2 THEN 'docs'
    WHEN 3 THEN 'help' WHEN 4 THEN 'perf' WHEN 5 THEN 'cleanup' ELSE 'wontfix' END""",
    "alias2": "CASE WHEN doc_id % 3 = 0 THEN 'question' ELSE 'other' END",
}
ISSUES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ISSUE_COLUMNS.items()) + " FROM {documents}"

SCORE_LOG = """
SELECT event_id, ts, event_type AS label, value AS confidence,
  CASE WHEN user_id % 2 = 0 THEN 'single' ELSE 'batch' END AS source,
  'u' || CAST(user_id AS STRING) AS uid
FROM {events}
"""

REPOS = """
SELECT p_partkey, p_name || '/' || CAST(p_partkey % 500 AS STRING) AS full_name,
  CAST(floor((p_retailprice - 850) * 100) AS BIGINT) AS stars, CAST(p_size AS BIGINT) * 5 AS issues,
  CASE CAST(substr(p_brand, 7) AS INT) % 15 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript'
    WHEN 2 THEN 'python' WHEN 3 THEN 'go' WHEN 4 THEN 'java' WHEN 5 THEN 'rust' WHEN 6 THEN 'ruby'
    WHEN 7 THEN 'php' WHEN 8 THEN 'jupyter-notebook' WHEN 9 THEN 'swift' WHEN 10 THEN 'dart'
    WHEN 11 THEN 'kotlin' WHEN 12 THEN 'c' WHEN 13 THEN 'cpp' ELSE NULL END AS language,
  CASE p_partkey % 9 WHEN 0 THEN 'web' WHEN 1 THEN 'cli' WHEN 2 THEN 'docker' WHEN 3 THEN 'react'
    WHEN 4 THEN 'database' WHEN 5 THEN 'library' WHEN 6 THEN 'security' WHEN 7 THEN 'framework'
    ELSE 'testing' END AS topic1,
  CASE p_size % 6 WHEN 0 THEN 'cli' WHEN 1 THEN 'pytorch' WHEN 2 THEN 'open-source'
    WHEN 3 THEN 'redis' WHEN 4 THEN 'kubernetes' ELSE lower(p_type) END AS topic2,
  p_partkey % 17 = 0 AS archived, p_partkey % 19 = 0 AS disabled,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 23 = 0 END AS fork
FROM {part}
"""

TICKETS = """
SELECT o_orderkey AS id, 'org/r' || CAST(o_custkey % 40 AS STRING) AS repo,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'bug' WHEN '2' THEN 'enhancement'
    WHEN '3' THEN 'documentation' WHEN '4' THEN 'question' ELSE 'performance' END AS label,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'type:bug' WHEN '2' THEN 'feature'
    WHEN '3' THEN 'doc' WHEN '4' THEN 'help' ELSE 'speed' END AS alias1,
  CASE o_orderstatus WHEN 'F' THEN 'refactoring' WHEN 'P' THEN 'bug' ELSE 'other' END AS alias2,
  CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
  o_orderdate AS updated_at, o_totalprice AS size
FROM {orders}
"""

REPO_DIM = """
SELECT 'org/r' || CAST(c_nationkey AS STRING) AS full_name,
  CAST(floor(max(c_acctbal)) AS BIGINT) AS stars, count(*) * 3 AS issues
FROM {customer} GROUP BY c_nationkey
"""

SEEN = "SELECT DISTINCT l_orderkey AS id FROM {lineitem} WHERE l_quantity > 45"

DONE = """
SELECT DISTINCT 'org/r' || CAST(c_nationkey AS STRING) AS repo,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'bug' WHEN 'MACHINERY' THEN 'enhancement'
    WHEN 'FURNITURE' THEN 'documentation' WHEN 'BUILDING' THEN 'question'
    ELSE 'performance' END AS label
FROM {customer} WHERE c_acctbal > 9900
"""

_TABLES = ("documents", "events", "part", "orders", "customer", "lineitem")


def duck(view: str) -> str:
    """The view's text for DuckDB."""
    return view.format(**{t: t for t in _TABLES})


def cte(**views: str) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB; CTE bodies may be views or SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({duck(v) if '{' in v else v})" for n, v in views.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def issues(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The view as a projection of the scan, so that rows keep their places in the files.

    ``more`` are columns of documents that stay.
    """
    return spread(documents(spark, sf_dir)).selectExpr(
        *[f"{e} AS {n}" for n, e in ISSUE_COLUMNS.items()], *more)


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(SCORE_LOG, events=table(spark, sf_dir, "events"))
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("uid", "user")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPOS, part=table(spark, sf_dir, "part")).withColumn(
        "topics", F.array("topic1", "topic2"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TICKETS, orders=table(spark, sf_dir, "orders")).withColumn(
        "labels", F.array("alias1", "alias2"))


def repo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPO_DIM, customer=table(spark, sf_dir, "customer"))


def seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEEN, lineitem=table(spark, sf_dir, "lineitem"))


def done_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DONE, customer=table(spark, sf_dir, "customer"))
