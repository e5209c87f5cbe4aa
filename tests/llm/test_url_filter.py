"""The glob automaton against regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamsift.llm import urlglob
from loamsift.llm.queries import URL_RULES
from loamsift.llm.urlglob import Rule


def plain(glob):
    """The same glob as a Python pattern."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1:end].replace("!", "^", 1) + "]", end + 1
        else:
            i += c == "\\"
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out)


def fits(globs, texts):
    got = [[] for _ in texts]
    for _, automaton in urlglob.blocks(globs):
        for own, row in zip(got, automaton.run([t.encode() for t in texts]), strict=True):
            own += row.tolist()
    return got


@pytest.mark.parametrize("seed,n_globs,size", [(1, 1, 4), (2, 40, 8), (3, 900, 12), (4, 6, 3)])
def test_automaton_equals_patterns(seed, n_globs, size):
    rng = random.Random(seed)
    parts = ["a", "b", "/", ".", "é", "漢", "*", "**", "?", "[ab]", "[!a]", "[a-c]", "\\*", "\\?", "-"]
    globs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(n_globs)]
    texts = ["", "/"] + ["".join(rng.choice("ab/.é漢*?-c") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    want = [[bool(plain(g).fullmatch(t)) for g in globs] for t in texts]
    assert fits(globs, texts) == want
    assert sum(map(sum, want)) > 0


def test_long_globs_cross_words_and_blocks():
    long = "ab" * 5000  # far more states than one block of words
    globs = [long + "*", "x" * 63, "x" * 64, "x" * 65, "**" + "y" * 130 + "**"]
    texts = [long, long + "c", long[:-1], "x" * 64, "x" * 65, "z" * 9 + "y" * 131 + "/"]
    assert fits(globs, texts) == [[bool(plain(g).fullmatch(t)) for g in globs] for t in texts]
    assert len(list(urlglob.blocks(globs))) > 1


def test_bad_globs_are_refused():
    for glob in ("a[bc", "[é]"):
        with pytest.raises(ValueError, match="class"):
            list(urlglob.blocks([glob]))
    with pytest.raises(ValueError, match="path"):
        urlglob.host_rules([("block", "x.com", "en/")])


def expected(url, rules=URL_RULES):
    """The listed rules by their wording."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    own = [(len(h + p), action, h + p) for action, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(own, default=(0, None, None))
    return host, path, best[2], best[1]


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://A.example.COM/en/x?y#z",
        "http://www.example.com/en/", "http://x.www.example.com/en", "http://wwwexample.com/en/1",
        "http://evil.org/foo.com/", "http://a.net/es/", "http://a.net/ES/", "http://net/fr/?x", "http://a.net#/fr/",
        "ftp://x://y.com/", "http://a\nb.com/c\nd", "http://É.com/en/", "http://free-bets.org", "http://a.casino.net/fr/",
        "http://a.org/casino", "http://u:p@b.net:80/es/x", "http://b.net:80/es/x"]


def test_judge_equals_wording(spark):
    long = "http://www.example.com/en/" + "a/" * 100_000
    rows = [(i, u, "x") for i, u in enumerate(URLS + [long, long.replace("/en/", "/e/")])]
    rows += [(None, "http://a.net/es/", "x"), (0, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "rule", "verdict", "rest", "own"):
        df = df.withColumn(name, F.lit("clash"))
    rules = urlglob.host_rules(URL_RULES) + [Rule("*casino**", "block"), Rule("*free-bets**", "block")]
    got = urlglob.judge(df, rules).collect()
    assert len(got) == len(rows) and got[0]["rest"] == "clash"
    for r in got:
        host, path, rule, action = expected(r["url"])
        action = action or ("block" if "casino" in host or "free-bets" in host else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action)
    assert urlglob.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlglob.judge(df, [], "block").collect()} == {"block"}


def test_listed_order_and_whole_hosts(spark):
    df = spark.createDataFrame([(1, "http://a.b/x/y"), (2, "http://b.c/x"), (3, "http://b")], "page_id long, url string")
    rules = urlglob.host_rules([("allow", "b", ""), ("block", "b", "/x/"), ("allow", "b", "/x/")])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlglob.judge(df, rules, "block").collect()}
    assert got == {1: ("b/x/", "block"), 2: (None, "block"), 3: ("b", "allow")}
