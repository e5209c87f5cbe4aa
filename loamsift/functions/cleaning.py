"""Title and body cleaning: ordered rules folded into one native expression."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions.regex import java
from loamsift.functions.text import contains_any, head_words, let, nfkc, strip


# A rule can only change a text that holds one of these pieces or matches the
# cheaper pattern below.
NEEDS = {
    "crlf": ("\r",), "html_comment": ("<!--",), "html_tag": ("<",), "entity": ("&",),
    "image": ("![",), "link": ("](",), "bold": ("*",), "strike": ("~~",), "header": ("#",),
    "table": ("|",), "quote": (">",), "checkbox": ("[ ]", "[x]", "[X]"), "code_block": ("```",),
    "inline_code": ("`",), "url": ("http", "www."), "issue_ref": ("#",), "template_header": ("#",),
    "placeholder": ("[",), "any_square": ("[",), "spaces": ("  ", "\t"),
    "blank_lines": ("\n\n\n",), "trace": ("Traceback (most", "Exception in thread"),
}
PROBES = {
    "trace": r"\([\w\.]+:\d", "version": r"\d\.\d", "file_path": r"/[\w.\-]+/[\w.\-]|" + fixed.FILE_SUFFIX,
    "hex": r"[0-9a-f]{7}",
}


class Rule(NamedTuple):
    """One replacement step; ``$1`` keeps capture group 1."""

    name: str
    pattern: str
    replacement: str

    def plain(self, c: Column) -> Column:
        return F.regexp_replace(c, java(self.pattern), self.replacement)

    def apply(self, c: Column) -> Column:
        """As ``plain``, skipping texts in which the pattern cannot match."""
        if self.name not in NEEDS and self.name not in PROBES:
            return self.plain(c)

        def guarded(t: Column) -> Column:
            possible = contains_any(t, NEEDS.get(self.name, ()))
            if self.name in PROBES:
                possible = possible | t.rlike(java(PROBES[self.name]))
            return F.when(possible, self.plain(t)).otherwise(t)
        return let(c, guarded)


class Cleaner(NamedTuple):
    """Rules for one text column plus the optional cut to the first words."""

    rules: tuple[Rule, ...]
    max_words: int | None = None


TITLE_V3 = Cleaner((
    Rule("crlf", fixed.CRLF, " "),
    Rule("html_tag", fixed.HTML_TAG, " "),
    Rule("entity", fixed.HTML_ENTITY, " "),
    Rule("image", fixed.MD_IMAGE, " "),
    Rule("url", fixed.URL, " "),
    Rule("issue_ref", fixed.ISSUE_REF, " "),
    Rule("square_prefix", fixed.TITLE_SQUARE_PREFIX, ""),
    Rule("round_prefix", fixed.TITLE_ROUND_PREFIX, ""),
    Rule("punct_run", fixed.PUNCT_RUN_V3, "$1"),
    Rule("spaces", fixed.SPACES, " "),
))

TITLE_FINAL = Cleaner((
    Rule("crlf", fixed.CRLF, " "),
    Rule("placeholder", fixed.PLACEHOLDER, " "),
    Rule("html_tag", fixed.HTML_TAG, " "),
    Rule("entity", fixed.HTML_ENTITY, " "),
    Rule("url", fixed.URL, " "),
    Rule("issue_ref", fixed.ISSUE_REF, " "),
    Rule("divider", fixed.DIVIDER, " "),
    Rule("any_prefix", fixed.TITLE_ANY_PREFIX, ""),
    Rule("any_square", fixed.TITLE_ANY_SQUARE, " "),
    Rule("inline_code", fixed.INLINE_CODE, " "),
    Rule("spaces", fixed.SPACES, " "),
))

BODY_V3 = Cleaner((
    Rule("crlf", fixed.CRLF, "\n"),
    Rule("html_comment", fixed.HTML_COMMENT, " "),
    Rule("checkbox", fixed.CHECKBOX, " "),
    Rule("image", fixed.MD_IMAGE, " "),
    Rule("rule", fixed.MD_RULE, " "),
    Rule("table", fixed.MD_TABLE, " "),
    Rule("quote", fixed.MD_QUOTE, " "),
    Rule("trace", fixed.TRACE_V3, " [STACKTRACE] "),
    Rule("code_block", fixed.CODE_BLOCK, " [CODE] "),
    Rule("inline_code", fixed.INLINE_CODE, " [CODE] "),
    Rule("url", fixed.URL, " [URL] "),
    Rule("version", fixed.VERSION, " [VERSION] "),
    Rule("file_path", fixed.FILE_PATH, " [FILEPATH] "),
    Rule("hex", fixed.HEX_FROM_7, " "),
    Rule("issue_ref", fixed.ISSUE_REF, " "),
    Rule("html_tag", fixed.HTML_TAG, " "),
    Rule("entity", fixed.HTML_ENTITY, " "),
    Rule("template_header", fixed.TEMPLATE_HEADER, " "),
    Rule("link", fixed.MD_LINK, "$1"),
    Rule("bold", fixed.MD_BOLD, "$1"),
    Rule("strike", fixed.MD_STRIKE, "$1"),
    Rule("header", fixed.MD_HEADER, " "),
    Rule("list", fixed.MD_LIST, " "),
    Rule("numbered", fixed.MD_NUMBERED, " "),
    Rule("punct_run", fixed.PUNCT_RUN_V3, "$1"),
    Rule("spaces", fixed.SPACES, " "),
    Rule("blank_lines", fixed.BLANK_LINES, "\n"),
), fixed.V3_HEAD_WORDS)

BODY_FINAL = Cleaner((
    Rule("crlf", fixed.CRLF, "\n"),
    Rule("placeholder", fixed.PLACEHOLDER, " "),
    Rule("html_comment", fixed.HTML_COMMENT, " "),
    Rule("code_block", fixed.CODE_BLOCK, " "),
    Rule("inline_code", fixed.INLINE_CODE, " "),
    Rule("trace", fixed.TRACE_FINAL, " "),
    Rule("log_line", fixed.LOG_LINE, " "),
    Rule("html_tag", fixed.HTML_TAG, " "),
    Rule("entity", fixed.HTML_ENTITY, " "),
    Rule("image", fixed.MD_IMAGE, " "),
    Rule("table", fixed.MD_TABLE, " "),
    Rule("rule", fixed.MD_RULE, " "),
    Rule("link", fixed.MD_LINK, "$1"),
    Rule("bold", fixed.MD_BOLD, "$1"),
    Rule("header", fixed.MD_HEADER, "\n"),
    Rule("list", fixed.MD_LIST, " "),
    Rule("url", fixed.URL, " "),
    Rule("hex", fixed.HEX_FROM_8, " "),
    Rule("issue_ref", fixed.ISSUE_REF, " "),
    Rule("punct_run", fixed.PUNCT_RUN_FINAL, "$1"),
    Rule("divider", fixed.DIVIDER, " "),
    Rule("spaces", fixed.SPACES, " "),
    Rule("blank_lines", fixed.BLANK_LINES, "\n"),
), fixed.FINAL_HEAD_WORDS)


def rewrite(c: Column | str, rules: tuple[Rule, ...]) -> Column:
    """NFKC, then the rules in order, then strip. NULL becomes ''."""
    text = nfkc(c)
    for rule in rules:
        text = rule.apply(text)
    return F.coalesce(strip(text), F.lit(""))


def clean(df: DataFrame, cleaners: dict[str, Cleaner]) -> DataFrame:
    """Clean the named columns in place; all other columns pass through.

    The whole chain of a column is one expression in one projection. It holds the
    non-deterministic NFKC call, so Spark neither duplicates it nor pushes filters
    through it: every text is cleaned once, whatever is built on top.
    """
    def full(name: str, cleaner: Cleaner) -> Column:
        text = rewrite(F.col(name), cleaner.rules)
        return head_words(text, cleaner.max_words) if cleaner.max_words else text
    return df.withColumns({n: full(n, c) for n, c in cleaners.items()})


def rule_named(cleaner: Cleaner, name: str) -> Rule:
    return next(r for r in cleaner.rules if r.name == name)
