"""Building blocks of the SQL twins; patterns are those of ``fixed`` in RE2's spelling."""

from __future__ import annotations

import re

from loamsift import fixed
from loamsift.functions import cleaning


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"
    return expr


BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def strip(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def wc(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '\\S+')) AS BIGINT)"


def head(expr: str, n: int) -> str:
    words = f"regexp_extract_all({expr}, '\\S+')"
    return (f"CASE WHEN len({words}) > {n} THEN array_to_string({words}[1:{n}], ' ') "
            f"ELSE {expr} END")


def mean1(expr: str) -> str:
    """Exact mean with one decimal, half to even."""
    return (f"round_even(round(CAST(sum(CAST({expr} AS DECIMAL(18, 6))) AS DOUBLE) "
            f"/ count(*), 9), 1)")


BLOCK_END = r"(?:[^\n]|\n[^\n])*"  # up to an empty line or the end; RE2 has no look-ahead


def re2(pattern: str) -> str:
    """A pattern of ``fixed`` in RE2's spelling.

    What keeps Java fast and changes no match goes: possessive repeats, hints by look-ahead and
    starts inside a refused run. Look-arounds at words become word boundaries.
    """
    pattern = pattern.replace(r"(?s:.)*?(?=\n\n|\z)", BLOCK_END).replace("(?s:.)", r"[\s\S]")
    pattern = re.sub(r"\(\?:\\G\|\(\?<!(?:\[[^\]]*\]|[^)\[])*\)\)", "", pattern)
    pattern = re.sub(r"\(\?=\[[^\]]*\](?:\{\d+\})?\)|\(\?!\[!-~\]\)", "", pattern)
    pattern = pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")
    pattern = re.sub(r"(?<=[+}])\+", "", pattern)
    return re.sub(r"\(\?([a-z]+)\)", lambda m: "(?" + "".join(c for c in m[1] if c in "im") + ")", pattern)


def steps(cleaner: cleaning.Cleaner) -> list[tuple[str, str]]:
    return [(re2(r.pattern), r.replacement.replace("$1", r"\1")) for r in cleaner.rules]


TAG, ENTITY, URL = re2(fixed.HTML_TAG), re2(fixed.HTML_ENTITY), re2(fixed.URL)
TITLE_V3, TITLE_FINAL = steps(cleaning.TITLE_V3), steps(cleaning.TITLE_FINAL)
BODY_V3, BODY_FINAL = steps(cleaning.BODY_V3), steps(cleaning.BODY_FINAL)
BOT_LOGIN, BOT_MENTION, SPAM = re2(fixed.BOT_LOGIN), re2(fixed.BOT_MENTION), re2(fixed.API_SPAM)


def cleaned(version: str, source: str = "issues") -> str:
    """SELECT with title and body cleaned; the body is cut in an outer step."""
    title, body, n = ((TITLE_V3, BODY_V3, 350) if version == "v3"
                      else (TITLE_FINAL, BODY_FINAL, 280))
    inner = (f"SELECT * EXCLUDE (title, body), coalesce({strip(chain('title', title))}, '') AS title, "
             f"coalesce({strip(chain('body', body))}, '') AS body FROM {source}")
    return f"SELECT * EXCLUDE (body), {head('body', n)} AS body FROM ({inner})"


def english(title: str, body: str, version: str) -> str:
    """Boolean expression of the English test."""
    n, allowed, stops, share = {
        "collect": (500, 4, fixed.STOP_WORDS_COLLECT, True),
        "v3": (500, 0, fixed.STOP_WORDS_V3, True),
        "final": (400, 4, fixed.STOP_WORDS_FINAL, False)}[version]
    t = strip(f"({title} || ' ' || left({body}, {n}))")

    def found(pattern: str) -> str:
        return f"(length({t}) - length(regexp_replace({t}, {q(pattern)}, '', 'g')))"
    tokens = f"regexp_extract_all(lower({t}), '\\S+')"
    vocab = "[" + ", ".join(q(w) for w in dict.fromkeys(stops)) + "]"
    foreign = f"len(list_intersect(list_distinct({tokens}), {vocab})) >= 3"
    scripts = [r"[\x{4e00}-\x{9fff}]", r"[\x{3040}-\x{30ff}]", r"[\x{0400}-\x{04ff}]",
               r"[\x{0600}-\x{06ff}]"]
    blocks = " ".join(f"WHEN {found(s)} > {allowed} THEN false" for s in scripts)
    ascii_words = (f"len(list_filter(regexp_extract_all({t}, '\\S+'), "
                   f"lambda w: NOT regexp_matches(w, '[^\\x00-\\x7F]')))")
    words = f"len(regexp_extract_all({t}, '\\S+'))"
    last = (f"WHEN {words} > 6 AND {ascii_words} / {words} < 0.70 THEN false" if share else "")
    return (f"(CASE WHEN length({t}) < 15 THEN true "
            f"WHEN {found('[^\\x00-\\x7F]')} / length({t}) > 0.12 THEN false "
            f"{blocks} WHEN {foreign} THEN false {last} ELSE true END)")


def template(body: str) -> str:
    hits = " OR ".join(f"contains(lower({body}), {q(p)})" for p in fixed.TEMPLATE_PHRASES)
    return f"({wc(body)} < 80 AND ({hits}))"


REASON = f"""CASE WHEN is_pr THEN 'pr'
  WHEN regexp_matches(coalesce(login, ''), {q(BOT_LOGIN)}) OR coalesce(user_type = 'Bot', false) THEN 'bot'
  WHEN {wc('t')} < 4 THEN 'short_title'
  WHEN b = '' THEN 'empty_body'
  WHEN {wc('b')} < 30 THEN 'short_body'
  WHEN {template('b')} THEN 'template'
  WHEN state = 'open' AND coalesce(comments, 0) < 2 THEN 'unacknowledged'
  WHEN NOT {english('t', 'b', 'collect')} THEN 'non_english'
  WHEN length(b) < 200 AND NOT contains(b, '.') AND NOT contains(b, chr(10)) THEN 'no_structure'
  END"""
STRIPPED = f"SELECT *, {strip('title')} AS t, {strip('body')} AS b FROM issues"
