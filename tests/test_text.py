import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamsift import fixed
from loamsift.functions import cleaning, language, text
from loamsift.functions.regex import java
from tests import samples

CHAINS = {"title_v3": cleaning.TITLE_V3, "title_final": cleaning.TITLE_FINAL,
          "body_v3": cleaning.BODY_V3, "body_final": cleaning.BODY_FINAL}


def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", make(F.col("s")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("which", CHAINS)
def test_each_rule_matches_python(spark, which):
    values = samples.texts(3000, seed=len(which))
    rules = CHAINS[which].rules
    assert len(rules) == len(samples.STEPS[which])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = df.select("i", *[r.apply(F.col("s")).alias(r.name) for r in rules],
                    *[r.plain(F.col("s")).alias("plain_" + r.name) for r in rules])
    for row in got.collect():
        source = values[row["i"]]
        for rule, (pattern, replacement) in zip(rules, samples.STEPS[which]):
            want = pattern.sub(replacement, source)
            assert row[rule.name] == want, (rule.name, source)
            assert row["plain_" + rule.name] == want, (rule.name, source)


@pytest.mark.parametrize("which", CHAINS)
def test_chain_matches_python(spark, which):
    values = samples.texts(3000, seed=99) + [None, "", " \n\t", "w " * 400, "x\ny " * 300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    for row in cleaning.clean(df, {"s": CHAINS[which]}).collect():
        assert row["s"] == samples.clean(values[row["i"]], which), values[row["i"]]


# Hand-written cases: rule, input, expected.
CASES = [
    ("body_v3", "punct_run", "a!?. b", "a. b"),
    ("body_v3", "trace", "Traceback (most recent call last)\nx\n", " [STACKTRACE] "),
    ("body_final", "trace", "a at b.C(d.java:1) z", "a  z"),
    ("body_v3", "trace", "a\n at b.C(d.java:1)\n at b.C(d.java:2)\n", None),
    ("body_v3", "rule", "---\u2028x\n---\ny", "---\u2028x\n \ny"),
    ("body_v3", "hex", "édeadbee abcdef0", "édeadbee  "),
    ("body_v3", "hex", "defaced 1234567 123456", "    123456"),
    ("body_v3", "bold", "**bold** *it* ***x***", "bold it x"),
    ("body_v3", "checkbox", "- [x] done\nrest", " \nrest"),
    ("body_v3", "checkbox", "- [y] done", None),
    ("body_v3", "version", "v1.2.3-rc1 and 3.14", " [VERSION]  and  [VERSION] "),
    ("body_v3", "file_path", "see src/a/b.ts or x.jsx!", None),
    ("body_v3", "table", "| a | b |\ntext | x", " \ntext | x"),
    ("body_v3", "quote", "> said\nno > quote", " said\nno > quote"),
    ("body_v3", "template_header", "## Steps to Reproduce now\nx", " \nx"),
    ("body_v3", "template_header", "##### Environment", None),
    ("body_v3", "link", "[docs](http://a.b) [x]", "docs [x]"),
    ("body_v3", "html_tag", "<b>x</b> 1 < 2", " x  1 < 2"),
    ("body_v3", "entity", "&amp; &#39; & x;", "    & x;"),
    ("body_v3", "image", "![a](b)!", " !"),
    ("body_v3", "numbered", "1. one\n2.two", " one\n2.two"),
    ("body_v3", "blank_lines", "a\n\n\n\nb\n\nc", "a\nb\n\nc"),
    ("body_final", "placeholder", "[ Inline Code ] [other]", "  [other]"),
    ("body_final", "log_line", "[2024-01-02T03:04 x\ny", " \ny"),
    ("body_final", "divider", "a ==== b --- c", "a   b --- c"),
    ("body_final", "header", "# T\nx", "\nT\nx"),
    ("body_final", "hex", "1234567 12345678", "1234567  "),
    ("title_v3", "square_prefix", "[BUG] crash", "crash"),
    ("title_v3", "round_prefix", "(fix) crash", "crash"),
    ("title_final", "any_prefix", "[WIP]: crash", "crash"),
    ("title_final", "any_square", "a [x] b", "a   b"),
]


@pytest.mark.parametrize("which,name,source,want", CASES)
def test_hand_written_steps(spark, which, name, source, want):
    rule = cleaning.rule_named(CHAINS[which], name)
    got = apply(spark, [source], rule.apply)[0]
    if want is None:
        position = [r.name for r in CHAINS[which].rules].index(name)
        pattern, replacement = samples.STEPS[which][position]
        want = pattern.sub(replacement, source)
    assert got == want


def test_url_before_link_is_kept(spark):
    df = spark.createDataFrame([("see [docs](https://a.b/c) and (x)",)], "s string")
    assert cleaning.clean(df, {"s": cleaning.BODY_V3}).first()["s"] == "see docs"


def test_long_inputs_do_not_overflow_or_crawl(spark):
    frames = "  at a.b.C(D.java:1)\n" * 60_000
    hard = [frames, "/a" * 100_000, "\n" * 100_000 + "x", "a-" * 100_000, " " * 100_000,
            "!" * 100_000]
    df = spark.createDataFrame([(s,) for s in hard], "s string")
    out = cleaning.clean(df.withColumn("t", F.col("s")),
                         {"s": cleaning.BODY_V3, "t": cleaning.BODY_FINAL})
    assert sorted(r["s"] for r in out.collect())[0] is not None
    assert out.where(F.col("s") == "[STACKTRACE]").count() == 1


def test_nfkc_in_jvm_and_arrow_agree_with_python(spark):
    values = ["ﬁx １２", "plain", None, "é", "²³", "ｶﾞ"] + samples.texts(300)
    want = [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert apply(spark, values, text.nfkc) == want
    assert apply(spark, values, text.nfkc_arrow) == want


@pytest.mark.parametrize("pattern", [r"\s", r"\S", r"[x\s]", r"[^\s]"])
def test_blank_classes_on_every_code_point(spark, pattern):
    # surrogates are no text, and a lone U+FEFF is a byte order mark to the decoder
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and c != 0xFEFF]
    chars = spark.range(1, 0x110000).where(
        "(id < 55296 OR id > 57343) AND id <> 65279").select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = {r["id"] for r in chars.where(F.col("c").rlike(f"^{java(pattern)}\\z")).select("id").collect()}
    assert got == {c for c in codes if re.fullmatch(pattern, chr(c))}


def test_strip_words_and_counts(spark):
    values = samples.texts(500, seed=3) + ["", "   ", " a \x1c b c \x85"]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]
    assert apply(spark, values, text.words) == [v.split() for v in values]
    assert apply(spark, values, text.word_count) == [len(v.split()) for v in values]
    assert apply(spark, [None], text.word_count) == [0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=40, max_size=40))
def test_cleaning_never_raises_and_leaves_no_placeholder(spark, values):
    df = spark.createDataFrame([(v.replace("\x00", ""),) for v in values], "s string")
    df = df.where(~F.col("s").rlike("[\\x{D800}-\\x{DFFF}]"))
    out = cleaning.clean(df, {"s": cleaning.BODY_FINAL})
    assert out.where(F.col("s").rlike(fixed.PLACEHOLDER_LEAK)).count() == 0


def test_digest_separates_fields(spark):
    row = spark.sql("SELECT 'ab' a, 'c' b, 'a' c, 'bc' d, CAST(NULL AS STRING) e, '' f")
    got = row.select(text.digest("a", "b").alias("x"), text.digest("c", "d").alias("y"),
                     text.digest("e").alias("n"), text.digest("f").alias("m")).first()
    assert got["x"] != got["y"] and got["n"] != got["m"]


@pytest.mark.parametrize("name,test,args", [
    ("collect", language.COLLECT, (500, 4, fixed.STOP_WORDS_COLLECT, True)),
    ("v3", language.V3, (500, 0, fixed.STOP_WORDS_V3, True)),
    ("final", language.FINAL, (400, 4, fixed.STOP_WORDS_FINAL, False)),
])
def test_english(spark, name, test, args):
    extra = ["我 有 和 plain english words around here", "que una por con del", "short", "",
             "ascii words only in this sentence of ten words total", "é " * 30,
             "naïve café résumé über straße jalapeño façade piñata words", "Не на это то"]
    titles = samples.texts(1500, seed=5) + extra
    bodies = samples.texts(1500, seed=6) + extra[::-1]
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(titles, bodies))],
                               "i int, t string, b string")
    for r in df.select("i", language.is_english("t", "b", test).alias("e")).collect():
        assert r["e"] == samples.english(titles[r["i"]], bodies[r["i"]], *args), (
            titles[r["i"]], bodies[r["i"]])


def test_head_and_foreign_words_of_long_words_and_all_blanks(spark):
    import time

    from loamsift.functions.language import _NON_ASCII_WORD
    from loamsift.functions.text import head_words
    texts = ["a b c d", "a\nb\n \n c  d", "a b c d\tx", "é b\x1cc\r\nd", "a b c", "", "a\x7fb c\x00d e f", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", head_words("t", 3).alias("h")).collect()
    want = [t if t is None or len(t.split()) <= 3 else " ".join(t.split()[:3]) for t in texts]
    assert [r["h"] for r in sorted(got, key=lambda r: r["i"])] == want
    long = spark.createDataFrame([("x" * 150_000 + " né é xéy x",)], "t string")
    start = time.time()
    assert long.select(F.regexp_count("t", F.lit(_NON_ASCII_WORD))).first()[0] == 3
    assert time.time() - start < 8  # the square of the word's length took far longer
