"""The permissive English test in its three parameterisations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions.regex import NON_SPACE_WIDE, java
from loamsift.functions.text import NON_ASCII, distinct_hits, let, prefix, strip, word_count

# Fixed values of the test.
MIN_JUDGED_CHARS = 15
MAX_NON_ASCII_SHARE = 0.12
MIN_STOP_WORDS = 3
SHARE_ABOVE_WORDS = 6
MIN_ASCII_WORD_SHARE = 0.70
SCRIPT_BLOCKS = (
    r"[\x{4E00}-\x{9FFF}]",
    r"[\x{3040}-\x{30FF}]",
    r"[\x{0400}-\x{04FF}]",
    r"[\x{0600}-\x{06FF}]",
)
# From a word's first such character to its end: one match a word, and none is tried at every letter.
_NON_ASCII_WORD = f"[{NON_SPACE_WIDE}]" + java(r"\S*+")


class EnglishTest(NamedTuple):
    body_chars: int
    script_chars_allowed: int
    stop_words: tuple[str, ...]
    ascii_word_share: bool


COLLECT = EnglishTest(500, 4, fixed.STOP_WORDS_COLLECT, True)
V3 = EnglishTest(500, 0, fixed.STOP_WORDS_V3, True)
FINAL = EnglishTest(400, 4, fixed.STOP_WORDS_FINAL, False)


def judged_text(title: Column, body: Column, test: EnglishTest) -> Column:
    return strip(F.concat(title, F.lit(" "), prefix(body, test.body_chars)))


def is_english(title: Column | str, body: Column | str, test: EnglishTest) -> Column:
    """Boolean column; the branches run in order and stop at the first verdict."""
    title = F.col(title) if isinstance(title, str) else title
    body = F.col(body) if isinstance(body, str) else body
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))  # null is empty
    return let(judged_text(title, body, test), lambda text: _verdict(text, test))


def _verdict(text: Column, test: EnglishTest) -> Column:
    non_ascii = F.regexp_count(text, F.lit(NON_ASCII))
    foreign = distinct_hits(text, test.stop_words) >= MIN_STOP_WORDS
    verdict = (
        F.when(F.length(text) < MIN_JUDGED_CHARS, True)
        .when(~text.rlike(NON_ASCII), ~foreign)
        .when(non_ascii / F.length(text) > MAX_NON_ASCII_SHARE, False)
    )
    for block in SCRIPT_BLOCKS:
        verdict = verdict.when(
            F.regexp_count(text, F.lit(block)) > test.script_chars_allowed, False)
    verdict = verdict.when(foreign, False)
    if test.ascii_word_share:
        n = word_count(text)
        ascii_words = n - F.regexp_count(text, F.lit(_NON_ASCII_WORD))
        verdict = verdict.when(
            (n > SHARE_ABOVE_WORDS) & (ascii_words / n < MIN_ASCII_WORD_SHARE), False)
    return verdict.otherwise(True)
