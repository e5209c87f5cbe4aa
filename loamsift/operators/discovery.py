"""Dimensions and joins of the collecting stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.operators.ranking import first_per_key, top_per_group

_ANY = "*"


def alias_dim(spark: SparkSession) -> DataFrame:
    """label, label_rank, alias, alias_rank. Some 27 rows by construction."""
    rows = [(label, fixed.LABELS_COLLECT.index(label), alias, i)
            for label, names in fixed.LABEL_ALIASES.items() for i, alias in enumerate(names)]
    return spark.createDataFrame(rows, "label string, label_rank int, alias string, alias_rank int")


def label_dim(spark: SparkSession, labels: tuple[str, ...] = fixed.LABELS_COLLECT) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)],
                                 "label string, label_rank int")


def parse_spec(text: Column) -> dict[str, Column]:
    """language, topic and min_stars of one search text; absent parts are NULL."""
    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return {"language": part(r"(?:^| )language:(\S+)"), "topic": part(r"(?:^| )topic:(\S+)"),
            "min_stars": part(r"(?:^| )stars:>(\d+)").cast("long")}


def spec_dim(spark: SparkSession, specs: tuple[str, ...] = fixed.DISCOVERY_SPECS) -> DataFrame:
    """spec_id, language, topic, min_stars of the fixed searches."""
    raw = spark.createDataFrame(list(enumerate(specs, 1)), "spec_id int, spec string")
    return raw.select("spec_id", *[c.alias(n) for n, c in parse_spec(F.col("spec")).items()])


def resolve_aliases(issues: DataFrame, dim: DataFrame, labels: str = "labels") -> DataFrame:
    """One row per (issue, known alias) with the canonical label."""
    return issues.withColumn("alias", F.explode(labels)).join(F.broadcast(dim), "alias")


def match_specs(repos: DataFrame, specs: DataFrame) -> DataFrame:
    """Repos x searches: language and topic equal or unspecified, stars above the bar.

    An unspecified part is stored as '*', and each repo offers its own values and
    '*', which turns the theta join into an equi join on (language, topic). The
    search table is fixed and small, so it is broadcast.
    """
    offers = (repos
              .withColumn("_language", F.explode(F.array(
                  F.coalesce("language", F.lit("")), F.lit(_ANY))))
              .withColumn("_topic", F.explode(F.array_distinct(F.concat(
                  F.coalesce("topics", F.array().cast("array<string>")),
                  F.array(F.lit(_ANY)))))))
    wanted = specs.select("spec_id", "min_stars",
                          F.coalesce("language", F.lit(_ANY)).alias("_language"),
                          F.coalesce("topic", F.lit(_ANY)).alias("_topic"))
    return (offers.join(F.broadcast(wanted), ["_language", "_topic"])
            .where(F.col("stars") > F.col("min_stars")).drop("_language", "_topic", "min_stars"))


def pages_per_spec(matches: DataFrame,
                   limit: int | None = fixed.PAGES_PER_SPEC * fixed.REPOS_PER_PAGE) -> DataFrame:
    """At most three pages of thirty repos per search, most stars first; None: no limit."""
    return matches if limit is None else top_per_group(
        matches, ["spec_id"], [F.desc("stars"), "full_name"], limit)


def first_match_per_repo(matches: DataFrame) -> DataFrame:
    return first_per_key(matches, ["full_name"], ["spec_id", F.desc("stars")])


def top_repos(repos: DataFrame, n: int | None = fixed.TOP_REPOS) -> DataFrame:
    """The ``n`` repos with most stars; None: all."""
    return repos if n is None else repos.orderBy(F.desc("stars"), "full_name").limit(n)


def of_repos(issues: DataFrame, repos: DataFrame) -> DataFrame:
    """Issues of the selected repos. No hint: Spark picks by the size of ``repos``."""
    dim = repos.select(F.col("full_name").alias("repo"), "stars", "issues")
    return issues.join(dim, "repo")


def pages_per_alias(rows: DataFrame,
                    limit: int | None = fixed.PAGES_PER_ALIAS * fixed.ISSUES_PER_PAGE) -> DataFrame:
    """At most ten pages of a hundred issues per (repo, alias), newest first; None: no limit."""
    return rows if limit is None else top_per_group(
        rows, ["repo", "alias"], [F.desc("updated_at"), "id"], limit)


def first_per_id(rows: DataFrame) -> DataFrame:
    """One row per issue id: first label, then first alias, then newest."""
    return first_per_key(rows, ["id"],
                         ["label_rank", "alias_rank", F.desc("updated_at"), "repo"])


def not_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Anti join on id. No hint: Spark picks by the size of the state table."""
    return rows.join(seen.select("id"), "id", "left_anti")


def not_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.select("label", "repo"), ["label", "repo"], "left_anti")


def base_per_repo(needed: int, n_repos: int) -> int:
    """Even share per repo with slack (fixed values 30 and 20)."""
    return max(30, needed // max(n_repos // 2, 1) + 20)


def cap_per_repo_label(rows: DataFrame, target: int, n_repos: int) -> DataFrame:
    """Per (repo, label) at most min(base, max(20, issues div 5)) rows.

    With a ``have`` column the base of a label follows from what it still needs.
    """
    most = base_per_repo(target, n_repos)
    base = F.lit(most)
    if "have" in rows.columns:
        share = F.floor((F.lit(target) - F.col("have")) / max(n_repos // 2, 1)) + 20
        base = F.greatest(F.lit(30), share)
    limit = F.least(base, F.greatest(F.lit(20), F.floor(F.col("issues") / 5)))
    return top_per_group(rows, ["repo", "label"],
                         ["alias_rank", F.desc("updated_at"), "id"], most, row_limit=limit)
