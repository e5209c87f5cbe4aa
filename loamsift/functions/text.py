"""Generic text functions as native Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamsift.functions.regex import java

# Every character Python's str.isspace() accepts.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NON_ASCII = r"[^\x00-\x7F]"
# GAP is one run of blanks. The first branch settles the usual single space, and the
# look-ahead refuses printable ASCII at once; neither changes what is matched.
_WORD = java(r"\S+")
GAP = java(r" (?=[!-~])|(?![!-~])\s+")
# Texts without any of these hold no blanks but spaces and line feeds.
_UNUSUAL = r"[\x00-\x09\x0B-\x1F\x7F-\x{10FFFF}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(c), body)[0]


def strip(c: Column | str) -> Column:
    """Remove Unicode blanks at both ends (a bare ``trim`` removes only spaces)."""
    return F.btrim(_col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and blank-only text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def words(c: Column | str) -> Column:
    """Blank-separated words; an empty array for blank text."""
    return F.filter(F.split(_col(c), GAP), lambda w: w != "")


def single_spaced(c: Column | str) -> Column:
    """The text with one space for every run of blanks, the usual ones found without classes."""
    return let(_col(c), lambda t: F.when(t.rlike(_UNUSUAL), F.regexp_replace(t, GAP, " ")).otherwise(
        F.regexp_replace(F.replace(t, F.lit("\n"), F.lit(" ")), " {2,}", " ")))


def word_count(c: Column | str) -> Column:
    """Number of words, 0 for NULL and blank text."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(_WORD)), F.lit(0))


def head_words(c: Column | str, n: int) -> Column:
    """First ``n`` words joined by one space, only when there are more than ``n``.

    ``c`` must be stripped. A text has more words if ``substring_index``, which builds no array
    of words, cuts some off.
    """
    def cut(t: Column) -> Column:
        return let(single_spaced(t), lambda s: let(F.substring_index(s, " ", n), lambda head: F.when(
            F.octet_length(head) < F.octet_length(s), head).otherwise(t)))
    return let(_col(c), cut)


def prefix(c: Column | str, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_col(c), 1, n)


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC inside the JVM, by the ICU library that Spark ships.

    Pure-ASCII text is its own NFKC form and skips the call. The expression is
    marked non-deterministic by Spark, which is what we want: a projection that
    holds it is evaluated once, and filters above are not pushed through it.
    """
    text = _col(c)
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def nfkc_arrow(c: Column | str) -> Column:
    """NFKC by Arrow UDF, for clusters without ICU on the class path.

    ASCII rows travel as NULL, so only text that can change is shipped to Python.
    """
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")
    text = _col(c)
    udf = F.pandas_udf(compose, T.StringType()).asNondeterministic()
    return F.coalesce(udf(F.when(text.rlike(NON_ASCII), text)), text)


def distinct_hits(c: Column | str, vocabulary: tuple[str, ...]) -> Column:
    """Number of distinct lower-cased tokens of ``c`` found in ``vocabulary``."""
    vocab = F.array(*[F.lit(w) for w in dict.fromkeys(vocabulary)])
    return F.size(F.array_intersect(F.split(F.lower(_col(c)), GAP), vocab))


def contains_any(c: Column | str, phrases: tuple[str, ...]) -> Column:
    """True when the text holds one of the literal phrases."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(_col(c), F.lit(phrase))
    return hit


def digest(*cols: Column | str) -> Column:
    """256-bit key of several texts, so that wide text need not be shuffled.

    Lengths are part of the key: ('ab','c') and ('a','bc') differ, NULL and '' too.
    """
    parts = []
    for c in cols:
        parts += [F.coalesce(F.length(_col(c)).cast("string"), F.lit("-")), F.lit(":"),
                  F.coalesce(_col(c), F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))
