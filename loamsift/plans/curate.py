"""The two curation flows as one recipe-driven plan.

The heavy part, cleaning whole texts, runs once over all rows and yields a narrow
verdict per row: why it was dropped, or 256-bit keys of its cleaned texts and its
word count. Dedup and the per-label cap work on verdicts only, so wide text is never
shuffled: verdicts carry the place of their row in the source's files, and the places of
the kept rows filter a second scan, whose rows are cleaned again for output. ``row_id``
must be stored with the data, so that both scans agree on it. A source that is not a scan of
Parquet files is stored first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import cleaning, language
from loamsift.functions.text import digest, is_blank, word_count
from loamsift.operators import gates, summary
from loamsift.operators.ranking import first_per_key, shuffled, top_per_group
from loamsift.session import spread, stash
from loamsift.sources.positions import PLACE, choose, file_backed, located


class Recipe(NamedTuple):
    name: str
    labels: tuple[str, ...]
    screen_name: str
    screen: Callable[[], Column]
    cleaners: dict[str, cleaning.Cleaner]
    min_title_words: int
    min_body_words: int
    english: language.EnglishTest
    dedup_keys: tuple[tuple[str, ...], ...]
    cap: int | None  # rows per label; None: all
    shuffle_seed: int | None
    required: tuple[str, ...]
    stages: tuple[str, ...]


V3 = Recipe(
    name="v3", labels=fixed.LABELS_V3,
    screen_name="spam", screen=lambda: gates.is_api_spam("body"),
    cleaners={"title": cleaning.TITLE_V3, "body": cleaning.BODY_V3},
    min_title_words=fixed.V3_TITLE_WORDS, min_body_words=fixed.V3_BODY_WORDS,
    english=language.V3, dedup_keys=(("title_key", "body_key"),),
    cap=fixed.V3_CAP, shuffle_seed=fixed.SHUFFLE_SEED, required=("title", "body", "label"),
    stages=("raw", "valid_label", "spam_removed", "word_gate", "english", "deduplicated",
            "balanced", "validated"))

FINAL = Recipe(
    name="final", labels=fixed.LABELS_FINAL,
    screen_name="bot", screen=lambda: gates.mentions_bot("title", "body"),
    cleaners={"title": cleaning.TITLE_FINAL, "body": cleaning.BODY_FINAL},
    min_title_words=fixed.FINAL_TITLE_WORDS, min_body_words=fixed.FINAL_BODY_WORDS,
    english=language.FINAL, dedup_keys=(("title_key", "label"), ("body_key", "label")),
    cap=fixed.FINAL_CAP, shuffle_seed=None, required=("repo", "title", "body", "label"),
    stages=("raw", "valid_label", "bots_removed", "word_gate", "english", "deduplicated",
            "balanced", "validated"))


def verdicts(raw: DataFrame, recipe: Recipe) -> DataFrame:
    """row_id, place, label, dropped_at, title_key, body_key, body_words, complete.

    ``raw`` must be file-backed (``positions.file_backed``).
    No row is filtered: rows refused before cleaning travel with NULL text, which
    the rule chain passes over, so one pass serves both the result and the funnel.
    """
    label = gates.normalised_label()
    early = F.when(~gates.valid_label(label, recipe.labels), "label").when(
        recipe.screen(), recipe.screen_name)
    marked = located(raw).select(
        "row_id", *PLACE, label.alias("label"), early.alias("_early"),
        (~is_blank("repo") if "repo" in recipe.required else F.lit(True)).alias("complete"),
        F.when(early.isNull(), F.col("title")).alias("title"),
        F.when(early.isNull(), F.col("body")).alias("body"))
    cleaned = cleaning.clean(marked, recipe.cleaners)
    judged = cleaned.withColumn("body_words", word_count("body")).withColumn(
        "dropped_at",
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when((word_count("title") < recipe.min_title_words)
              | (F.col("body_words") < recipe.min_body_words), "words")
        .when(~language.is_english("title", "body", recipe.english), "non_english"))
    passed = F.col("dropped_at").isNull()
    # observe() is a barrier: without it a filter on dropped_at would be pushed below
    # and all of the above evaluated twice.
    return judged.select(
        "row_id", *PLACE, "label", "dropped_at",
        F.when(passed, digest("title")).alias("title_key"),
        F.when(passed, digest("body")).alias("body_key"),
        "body_words", "complete").observe(f"verdicts-{uuid.uuid4().hex}",
                                          F.count(F.lit(1)).alias("rows"))


def survivors(v: DataFrame, recipe: Recipe) -> DataFrame:
    """Passed rows after the dedup passes, in their order; lower row_id wins."""
    rows = v.where(F.col("dropped_at").isNull())
    for keys in recipe.dedup_keys:
        rows = first_per_key(rows, keys, ["row_id"])
    return rows


def balanced(unique: DataFrame, recipe: Recipe) -> DataFrame:
    """Per label the longest bodies up to the cap, if any; ties go to the lower row_id."""
    narrow = unique.select("row_id", *PLACE, "label", "body_words", "complete")
    return narrow if recipe.cap is None else top_per_group(
        narrow, ["label"], [F.desc("body_words"), "row_id"], recipe.cap)


def finish(raw: DataFrame, kept: DataFrame, recipe: Recipe) -> DataFrame:
    """Clean the rows at the kept places for output."""
    rows = choose(raw, kept)
    rows = rows.select("row_id", "repo", "title", "body", gates.normalised_label().alias("label"))
    out = gates.complete_rows(cleaning.clean(rows, recipe.cleaners), recipe.required,
                              recipe.labels)
    return out.select("row_id", "repo", "title", "body", "label")


def ordered(result: DataFrame, recipe: Recipe) -> DataFrame:
    """Apply the seeded shuffle of the recipe, if it has one."""
    return result if recipe.shuffle_seed is None else shuffled(result, recipe.shuffle_seed)


def curate(raw: DataFrame, recipe: Recipe) -> DataFrame:
    """Curated rows (row_id, repo, title, body, label).

    Verdicts and the result are stored on the way, so neither ranking nor the final order
    cleans a text again: one pass over all texts and one over those kept.
    """
    return Curation(raw, recipe).result()


class Curation:
    """One run whose parts share a single cleaning pass.

    Verdicts, kept places and the result are written to the shared scratch folder on first
    use, so the source is scanned twice however many reports are drawn. Counts come from these
    tables, not from accumulators, so a task that runs twice cannot be counted twice. A source
    whose few row groups would leave most cores idle is dealt out first.
    """

    def __init__(self, raw: DataFrame, recipe: Recipe):
        self.raw, self.recipe = file_backed(spread(raw)), recipe

    @cached_property
    def verdicts(self) -> DataFrame:
        return stash(verdicts(self.raw, self.recipe), f"verdicts-{self.recipe.name}")

    @cached_property
    def survivors(self) -> DataFrame:
        rows = survivors(self.verdicts, self.recipe)
        return stash(rows.select("row_id", *PLACE, "label", "body_words", "complete"),
                     f"survivors-{self.recipe.name}")

    @cached_property
    def kept(self) -> DataFrame:
        return stash(balanced(self.survivors, self.recipe), f"kept-{self.recipe.name}")

    @cached_property
    def table(self) -> DataFrame:
        return stash(finish(self.raw, self.kept, self.recipe),
                     f"curated-{self.recipe.name}")

    def result(self) -> DataFrame:
        return ordered(self.table, self.recipe)

    def funnel(self) -> DataFrame:
        """stage_no, stage, n: rows left after every stage."""
        passed = {"label": 1, self.recipe.screen_name: 2, "words": 3, "non_english": 4}
        reached = F.coalesce(F.element_at(F.create_map(
            *[F.lit(x) for kv in passed.items() for x in kv]), F.col("dropped_at")), F.lit(5))
        row_wise = self.verdicts.agg(*[
            F.count_if(reached > i).alias(str(i)) for i in range(5)])
        early = row_wise.select(F.posexplode(F.array(*[F.col(f"`{i}`") for i in range(5)]))
                                .alias("i", "n"))
        late = [self.survivors.agg(F.lit(5).alias("i"), F.count("*").alias("n")),
                self.kept.agg(F.lit(6).alias("i"), F.count("*").alias("n")),
                self.kept.agg(F.lit(7).alias("i"), F.count_if("complete").alias("n"))]
        rows = early
        for df in late:
            rows = rows.unionByName(df)
        names = F.array(*[F.lit(s) for s in self.recipe.stages])
        return rows.select((F.col("i") + 1).alias("stage_no"),
                           F.element_at(names, F.col("i") + 1).alias("stage"), "n")

    def reasons(self) -> DataFrame:
        return summary.reason_histogram(
            self.verdicts.withColumnRenamed("dropped_at", "reason"))

    def report(self) -> DataFrame:
        return report(self.table, self.funnel())


def retention(funnel: DataFrame) -> DataFrame:
    """Last stage over first stage in percent, NULL for an empty input."""
    return funnel.agg(
        F.bround(F.max_by("n", "stage_no")
                 / F.nullif(F.min_by("n", "stage_no"), F.lit(0)) * 100, 1).alias("retention_pct"))


def report(result: DataFrame, funnel: DataFrame) -> DataFrame:
    """(section, line, metric, value) rows: funnel, classes, words, audits."""
    def block(df: DataFrame, section: str, line: Column, metric: Column, value: Column):
        return df.select(F.lit(section).alias("section"), line.cast("int").alias("line"),
                         metric.alias("metric"), value.cast("string").alias("value"))
    one = F.lit(1)
    stats = summary.word_stats(result, "title", "body").select(
        "column", F.inline(F.array(*[
            F.struct(F.lit(n).alias("stat"), F.format_number(F.col(f"{n}_words"), 1).alias("v"))
            for n in ("mean", "median", "min", "max")])))
    parts = [
        block(funnel, "1 stages", F.col("stage_no"), F.col("stage"), F.format_number("n", 0)),
        block(retention(funnel), "2 retention", one, F.lit("retention_pct"),
              F.col("retention_pct")),
        block(summary.class_shares(result), "3 classes", one, F.col("label"),
              F.format_string("%,d (%.1f%%)", F.col("n"), F.col("pct"))),
        block(summary.balance_ratio(result), "4 balance", one, F.lit("balance_ratio"),
              F.format_number("balance_ratio", 2)),
        block(stats, "5 words", one, F.concat_ws("_", "column", "stat"), F.col("v")),
        block(summary.placeholder_leak(result), "6 leak", one, F.lit("placeholders"),
              F.col("placeholders")),
        block(summary.cell_audit(result).select(F.inline(F.array(
            F.struct(F.lit("nulls").alias("k"), F.col("nulls").alias("v")),
            F.struct(F.lit("empties").alias("k"), F.col("empties").alias("v"))))),
            "7 cells", one, F.col("k"), F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
