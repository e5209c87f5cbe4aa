"""Row predicates and the ordered quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions.language import COLLECT, is_english
from loamsift.functions.regex import java
from loamsift.functions.text import contains_any, is_blank, let, prefix, strip, word_count


def normalised_label(c: Column | str = "label") -> Column:
    return F.lower(strip(c))


def valid_label(c: Column | str, labels: tuple[str, ...]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin(*labels), F.lit(False))


def filter_labels(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Normalise ``label`` and keep the rows of the domain."""
    return df.withColumn("label", normalised_label()).where(valid_label("label", labels))


def is_api_spam(body: Column | str = "body") -> Column:
    return F.coalesce(prefix(body, fixed.SPAM_WINDOW_CHARS).rlike(java(fixed.API_SPAM)),
                      F.lit(False))


def mentions_bot(*cols: Column | str) -> Column:
    hits = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        hits.append(F.coalesce(c.rlike(fixed.BOT_MENTION), F.lit(False)))
    return reduce(lambda a, b: a | b, hits)


def written_by_bot(login: Column, user_type: Column) -> Column:
    return F.coalesce(login, F.lit("")).rlike(fixed.BOT_LOGIN) | user_type.eqNullSafe("Bot")


def is_template(body: Column) -> Column:
    return ((word_count(body) < fixed.TEMPLATE_BELOW_WORDS)
            & contains_any(F.lower(body), fixed.TEMPLATE_PHRASES))


def is_unacknowledged(state: Column, comments: Column) -> Column:
    return F.coalesce((state == "open") & (F.coalesce(comments, F.lit(0)) < 2), F.lit(False))


def lacks_structure(body: Column) -> Column:
    return ((F.length(body) < fixed.STRUCTURE_BELOW_CHARS)
            & ~F.contains(body, F.lit(".")) & ~F.contains(body, F.lit("\n")))


def rejection_reason(
    title: str = "title", body: str = "body", login: str = "login", user_type: str = "user_type",
    state: str = "state", comments: str = "comments", is_pr: str = "is_pr",
) -> Column:
    """First failing check of the gate, NULL for a row that passes."""
    def checks(t: Column, b: Column, n_words: Column) -> Column:
        short = n_words < fixed.TEMPLATE_BELOW_WORDS
        return (
            F.when(F.coalesce(F.col(is_pr), F.lit(False)), "pr")
            .when(written_by_bot(F.col(login), F.col(user_type)), "bot")
            .when(word_count(t) < fixed.COLLECT_TITLE_WORDS, "short_title")
            .when(b == "", "empty_body")
            .when(n_words < fixed.COLLECT_BODY_WORDS, "short_body")
            .when(short & contains_any(F.lower(b), fixed.TEMPLATE_PHRASES), "template")
            .when(is_unacknowledged(F.col(state), F.col(comments)), "unacknowledged")
            .when(~is_english(t, b, COLLECT), "non_english")
            .when(lacks_structure(b), "no_structure")
        )
    texts = F.struct(F.coalesce(strip(title), F.lit("")).alias("t"),
                     F.coalesce(strip(body), F.lit("")).alias("b"),
                     word_count(body).alias("n"))
    return let(texts, lambda x: checks(x["t"], x["b"], x["n"]))


def complete_rows(df: DataFrame, columns: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """Final guarantee: no listed column is NULL or blank and the label is known."""
    ok = reduce(lambda a, b: a & b, [~is_blank(c) for c in columns])
    return df.where(ok & valid_label("label", labels))


def eligible_repo(
    stars: str = "stars", issues: str = "issues",
    flags: tuple[str, ...] = ("archived", "disabled", "fork"),
) -> Column:
    ok = ((F.coalesce(F.col(stars), F.lit(0)) >= fixed.MIN_STARS)
          & (F.coalesce(F.col(issues), F.lit(0)) >= fixed.MIN_OPEN_ISSUES))
    for flag in flags:
        ok = ok & ~F.coalesce(F.col(flag), F.lit(False))
    return ok


def valid_upload_rows(df: DataFrame) -> DataFrame:
    """Strip the title, drop rows without one, turn a missing body into ''."""
    return (df.withColumn("title", strip("title")).where(~is_blank("title"))
            .withColumn("body", F.coalesce("body", F.lit(""))))


def guard_batch(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Refuse an empty batch or, when a limit is given, one above it.

    ``max_rows`` is a service limit of the caller; bulk jobs leave it unset.
    The check reads at most ``max_rows + 1`` rows.
    """
    if df.isEmpty():
        raise ValueError("the batch has no row with a title")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the batch has more than {max_rows} rows")
    return df


def guard_record(title: str | None, body: str | None) -> None:
    if not (title or "").strip() and not (body or "").strip():
        raise ValueError("give at least a title or a body")


def emit_record(df: DataFrame, max_chars: int | None = fixed.MAX_BODY_CHARS) -> DataFrame:
    """Collected row: stripped title, stripped body of at most ``max_chars``, canonical label.

    ``max_chars`` None keeps whole bodies.
    """
    body = F.coalesce(strip("body"), F.lit(""))
    return df.select("id", "repo", strip("title").alias("title"),
                     (body if max_chars is None else prefix(body, max_chars)).alias("body"), "label")
