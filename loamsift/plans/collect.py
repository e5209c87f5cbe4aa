"""Collecting on landed JSON: choose repos, match labels, gate, cap and fill quotas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.operators import discovery, gates, summary
from loamsift.operators.ranking import first_per_key, within_quota
from loamsift.session import stash
from loamsift.sources.positions import PLACE, choose, file_backed, located


class Collected(NamedTuple):
    rows: DataFrame
    seen: DataFrame
    done: DataFrame


def choose_repos(repos: DataFrame, specs: DataFrame, n: int | None = fixed.TOP_REPOS,
                 per_spec: int | None = fixed.PAGES_PER_SPEC * fixed.REPOS_PER_PAGE) -> DataFrame:
    """full_name, stars, language, issues of the ``n`` best eligible matched repos.

    ``per_spec`` is the remote API's limit on results of one search; None, for either
    number, sets no limit.
    """
    pages = discovery.pages_per_spec(discovery.match_specs(repos, specs), per_spec)
    eligible = pages.where(gates.eligible_repo())
    unique = discovery.first_match_per_repo(eligible)
    return discovery.top_repos(unique.select("full_name", "stars", "language", "issues"), n)


def candidates(issues: DataFrame, repos: DataFrame, aliases: DataFrame, seen: DataFrame,
               done: DataFrame, have: DataFrame, target: int = fixed.TARGET_PER_LABEL,
               per_alias: int | None = fixed.PAGES_PER_ALIAS * fixed.ISSUES_PER_PAGE) -> DataFrame:
    """Closed, unseen issues of open labels and open (label, repo) pairs, without their text.

    One narrow row per (id, label). A label that has its target is not fetched at all, so
    it claims no id. ``per_alias`` is the page limit of the remote API, None for none.
    """
    closed = issues.where(F.col("state") == "closed").select("id", "repo", "labels", "updated_at")
    rows = discovery.resolve_aliases(discovery.of_repos(closed, repos), aliases)
    rows = (rows.join(have.select("label", "have"), "label", "left")
            .withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < target))
    rows = discovery.pages_per_alias(discovery.not_done(rows, done), per_alias)
    rows = first_per_key(rows, ["id", "label"], ["alias_rank", F.desc("updated_at"), "repo"])
    return discovery.not_seen(rows, seen)


def collect(issues: DataFrame, repos: DataFrame, aliases: DataFrame, seen: DataFrame,
            done: DataFrame, have: DataFrame, n_repos: int = fixed.TOP_REPOS,
            target: int = fixed.TARGET_PER_LABEL,
            per_alias: int | None = fixed.PAGES_PER_ALIAS * fixed.ISSUES_PER_PAGE,
            max_chars: int | None = fixed.MAX_BODY_CHARS) -> Collected:
    """New records, ids to remember and finished pairs.

    ``have`` is (label, have): rows of earlier runs, one per label. Remembered are rejected
    and emitted ids and nothing else: what a cap or a quota leaves over stays open for
    another label and for a later run. Labels take their turns in rank order, so an issue of
    two labels goes to the second when the first does not take it. Ranking works on narrow
    rows; each text is read and judged once. An id landed several times has its newest text.
    """
    narrow = stash(candidates(issues, repos, aliases, seen, done, have, target, per_alias),
                   "candidates")
    issues = file_backed(issues)
    landed = located(issues).select("id", "updated_at", "repo", *PLACE)
    newest = first_per_key(landed.join(narrow.select("id").distinct(), "id", "left_semi"),
                           ["id"], [F.desc("updated_at"), "repo", *PLACE])
    texts = choose(issues, newest)
    judged = stash(texts.withColumn("reason", gates.rejection_reason()), "judged")
    pool = stash(narrow.join(judged.where(F.col("reason").isNull()).select("id"), "id"), "pool")
    pair = ["label", "repo", "stars"]
    looked_at = narrow.select(*pair).distinct()
    kept = taken = None
    for row in aliases.select("label", "label_rank").distinct().orderBy("label_rank").collect():
        own = pool.where(F.col("label") == row["label"])  # one turn for each of the few labels
        if kept is not None:
            own = own.join(kept.select("id"), "id", "left_anti")
        capped = stash(discovery.cap_per_repo_label(own, target, n_repos), "capped")
        counts = looked_at.where(F.col("label") == row["label"]).join(
            capped.groupBy(*pair).agg(F.count("*").alias("n")), pair, "left").na.fill(0, ["n"])
        pairs = stash(within_quota(counts, target, have), "taken")
        got = capped.join(pairs, ["label", "repo"], "left_semi").select("id", "label", "repo")
        taken = pairs if taken is None else taken.unionByName(pairs)
        kept = got if kept is None else kept.unionByName(got)
    kept = stash(kept, "kept")
    rows = gates.emit_record(judged.drop("repo").join(kept, "id"), max_chars)
    remembered = judged.where(F.col("reason").isNotNull()).select("id", "reason").unionByName(
        kept.select("id", F.lit(None).cast("string").alias("reason")))
    return Collected(rows, remembered, taken)


def coverage(rows: DataFrame, labels: DataFrame, target: int = fixed.TARGET_PER_LABEL) -> DataFrame:
    return summary.shortfall(summary.count_by(rows, "label"), labels, target)
