"""Random issue-like texts and a plain-Python model of the text rules."""

from __future__ import annotations

import random
import re
import unicodedata

from suite import duck

FRAGMENTS = [
    "word", "Word", "the ", "at ", " at a.b.C(x.java:12)\n", "\n  at q.R$s(F.kt:7)", "\n", "\n\n",
    "\r\n", "\r", " ", "\t", "  ", "`code`", "```\nblock\n```", "```", "<b>", "</b>", "<", ">",
    "<!-- note -->", "<!--", "-->", "&amp;", "&#12;", "&nbsp;", "![a](b)", "[x](y)", "[", "]", "(",
    ")", "- [x] done\n", "- [ ] todo", "* item", "\n- item", "\n+ item", "\n1. one", "\n> q", "> ",
    "---", "\n---\n", "***", "___", "===", "| a | b |", "\n| a | b |\n", "**bold**", "*it*", "~~s~~",
    "#12", "# Head", "\n## Steps to reproduce: x\n", "\n### Environment", "#", "http://a.b/c",
    "www.x.y", "https://", "v1.2.3", "1.2", "3.14-rc_1", "a.py", "src/a/b.ts", "/usr/lib/x", "x.jsx",
    "a.js-b.py", "deadbeef01", "abcdef0", "édeadbee", "deadbeefé", "1234567", "!!!", "?!.", "...",
    ",,,", "-", "Traceback (most recent call last)", "\n  File x\nError: y", "Exception in thread m",
    "2024-01-02 03:04 INFO", "\n[2024/01/02T03:04:05] log", "[CODE]", "[ url ]", "[inline code]",
    "[STACKTRACE]", "[BUG] ", "(fix) ", "é", "ß", "中文", "の", "не", " ", "\x85", "\xa0", "１２",
    "ﬁ", "²", "_", "İ", "\x1c", "que ", "los ", "para ", "codecov",
]


def texts(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


_END = r"[\s\S]*?(?=\n\n|\Z)"


def _python(steps):
    out = []
    for pattern, replacement in steps:
        pattern = pattern.replace(duck.BLOCK_END, _END)
        out.append((re.compile(pattern), replacement))
    return out


STEPS = {"title_v3": _python(duck.TITLE_V3), "title_final": _python(duck.TITLE_FINAL),
         "body_v3": _python(duck.BODY_V3), "body_final": _python(duck.BODY_FINAL)}
HEAD = {"body_v3": 350, "body_final": 280}


def clean(text: str | None, which: str) -> str:
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", text)
    for pattern, replacement in STEPS[which]:
        text = pattern.sub(replacement, text)
    text = text.strip()
    words = text.split()
    n = HEAD.get(which)
    return " ".join(words[:n]) if n and len(words) > n else text


_SCRIPTS = [range(0x4E00, 0xA000), range(0x3040, 0x3100), range(0x400, 0x500), range(0x600, 0x700)]


def english(title: str, body: str, n: int, allowed: int, stops, share: bool) -> bool:
    text = f"{title} {body[:n]}".strip()
    codes, tokens = [ord(c) for c in text], text.split()
    refusals = [
        sum(c > 127 for c in codes) > 0.12 * len(codes),
        max(sum(c in block for c in codes) for block in _SCRIPTS) > allowed,
        len(set(stops).intersection(text.lower().split())) > 2,
        share and len(tokens) > 6 and sum(map(str.isascii, tokens)) / len(tokens) < 0.70,
    ]
    return len(text) < 15 or not any(refusals)
