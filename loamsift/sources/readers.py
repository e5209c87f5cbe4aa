"""Sources: CSV, landed JSON pages, uploads, configs and state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamsift import fixed
from loamsift.session import stash
from loamsift.sources import schemas
from loamsift.sources.committed import CommittedTable
from loamsift.sources.csv_split import PLACED, read_split

# Quotes are doubled, bodies may hold newlines, blanks are data.
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "enforceSchema": "false"}


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(*fixed.NA_TOKENS), None).otherwise(c)


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def with_defaults(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add the missing ones of ``columns`` as empty text."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None,
             split: bool = False) -> DataFrame:
    """All-text CSV scan with header clean-up and missing-value tokens as NULL.

    Columns are bound by the header's names, whatever their order; ``columns`` picks some of
    them and fails when one is missing. Files whose headers differ are refused. Multi-line CSV
    is read one file per task; with ``split`` large files are read by many tasks, and rows
    carry ``_file``, ``_block`` and ``_line``, their place in the files.
    """
    if split:
        df = normalise_header(read_split(spark, path, CSV_READ))
    else:
        df = normalise_header(spark.read.options(**CSV_READ).csv(path))
    if columns:
        df = require_columns(df, columns)
    place = list(PLACED) if split else []
    own = columns or [c for c in df.columns if c not in place]
    return df.select(*place, *[na_to_null(F.col(c)).alias(c) for c in own])


def read_issue_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed issue JSON; error payloads and unreadable bodies are skipped.

    An error object has no ``id``; a body that is not JSON fills the corrupt column
    and has no ``id`` either. ``multi_line`` is for files holding one array page.
    """
    reader = spark.read.schema(schemas.ISSUE_API + ", _corrupt string").options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt",
        multiLine=str(multi_line).lower())
    return reader.json(path).where(F.col("id").isNotNull()).drop("_corrupt")


def store_with_row_ids(df: DataFrame, path: str) -> DataFrame:
    """Write the rows of a file scan as Parquet with a ``row_id`` and read them back.

    Ids count from 0 in the order of (file path, position in the file), so a lower id is an
    earlier row however Spark packs files into tasks. A block of a file is read by one task
    in order, or its rows carry their place (``read_csv`` with ``split``): a block's first id
    follows from the row counts of the blocks before it.
    """
    placed = all(c in df.columns for c in PLACED)
    place = {"_at": F.col("_line")} if placed else {
        "_file": F.input_file_name(), "_block": F.input_file_block_start(),
        "_at": F.monotonically_increasing_id()}
    tagged = stash(df.withColumns(place), "tagged")
    blocks = tagged.groupBy("_file", "_block").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = [c for c in df.columns if not placed or c not in PLACED]
    tagged.join(blocks, ["_file", "_block"]).withColumn(
        "row_id", F.col("_offset") + F.col("_at") - F.col("_first")).select(
        *own, "row_id").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def flatten_issue(df: DataFrame) -> DataFrame:
    """Nested API issue -> flat columns of the quality gate."""
    return df.select(
        "id", "repo", "title", "body", "state", "comments", "labels", "updated_at",
        F.col("user.login").alias("login"), F.col("user.type").alias("user_type"),
        F.col("pull_request").isNotNull().alias("is_pr"))


def read_repo_pages(spark: SparkSession, path: str) -> DataFrame:
    """Search pages -> one row per repo with our column names."""
    pages = spark.read.schema(schemas.REPO_PAGE).json(path)
    item = F.col("item")
    return pages.select(F.explode("items").alias("item")).select(
        item.full_name.alias("full_name"),
        F.coalesce(item.stargazers_count, F.lit(0)).alias("stars"),
        F.coalesce(item.open_issues_count, F.lit(0)).alias("issues"),
        F.coalesce(item.language, F.lit("")).alias("language"),
        item.archived.alias("archived"), item.disabled.alias("disabled"), item.fork.alias("fork"),
        item.topics.alias("topics"))


def read_repo_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Cached catalog of selected repos."""
    return spark.read.schema(schemas.REPOS).json(path)


def read_upload(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Upload by file suffix; ``title`` is required, ``body`` optional.

    JSON of unknown columns costs Spark one more pass unless ``schema`` is given.
    """
    name = path.lower().rstrip("/")
    if name.endswith(".csv"):
        df = read_csv(spark, path)
    elif name.endswith((".json", ".jsonl")):
        df = normalise_header((spark.read.schema(schema) if schema else spark.read).json(path))
    elif name.endswith(".parquet"):
        df = normalise_header(spark.read.parquet(path))
    else:
        raise ValueError("only .csv, .json, .jsonl and .parquet are read")
    return with_defaults(require_columns(df, ("title",)), ("body",))


def read_label_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(schemas.LABEL_CONFIG).json(path)


def label_names(config: DataFrame) -> DataFrame:
    """label_id, label by the config's id map, checked against its name map."""
    by_id = config.select(F.explode("id2label").alias("id_text", "label"), "labels")
    return by_id.select(F.col("id_text").cast("int").alias("label_id"), "label",
                        F.element_at("labels", F.col("label")).alias("declared_id"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training results, one row per history entry; absent values are 0 or empty."""
    df = spark.read.option("multiLine", "true").schema(schemas.MODEL_RESULTS).json(path)
    return df.select(
        F.posexplode_outer("history").alias("step", "entry"),
        F.coalesce("test_acc", F.lit(0.0)).alias("test_acc"),
        F.coalesce("test_f1", F.lit(0.0)).alias("test_f1"),
        F.coalesce("test_report", F.lit("")).alias("test_report"))


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seen ids, done pairs) of earlier runs; empty tables when there is none."""
    state = CommittedTable(spark, path)
    return state.read("seen", schemas.SEEN), state.read("done", schemas.DONE)


def read_log(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """The committed score log with its ``day``, all of it or some days."""
    return CommittedTable(spark, path).read("log", f"{schemas.SCORE_LOG}, day date", "day", days)


def newest_days(spark: SparkSession, path: str, n: int) -> list[str]:
    """The fewest newest days that hold ``n`` log rows, by the counts of the commit list.

    Rows without a time come last: they are among the days when all others hold fewer rows.
    """
    counts: dict[str, int] = {}
    for entry in CommittedTable(spark, path).listing().of("log"):
        for day, rows in entry.counts.items():
            counts[day] = counts.get(day, 0) + rows
    days, found = [], 0
    for day in sorted(counts, reverse=True):  # "" (no time) is the smallest
        if found >= n:
            break
        days.append(day)
        found += counts[day]
    return days


def read_newest(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Whole newest days of the log that hold ``n`` rows: what a view of the last rows needs."""
    return read_log(spark, path, newest_days(spark, path, n)).drop("day")


def read_log_sums(spark: SparkSession, path: str) -> DataFrame:
    """label, source, n, summed, total of the whole log, from the sums of its commits."""
    return CommittedTable(spark, path).read("sums", schemas.LOG_SUMS).groupBy("label", "source").agg(
        *[F.sum(c).alias(c) for c in ("n", "summed", "total")])
