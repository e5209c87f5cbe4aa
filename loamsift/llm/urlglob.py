"""URL filter: glob rules as a bit-parallel automaton that runs all of them at once.

A rule is a glob over the canonical URL, ``"." + host + path``. Every rule takes one bit for its
start and one for each character it consumes; rules lie side by side in words of 64 bits. With
``B[c]`` the states that byte c may enter and ``L[c]`` the states it may stay in (the loops of
wildcards), one step of all rules over a byte is ``D = ((D << 1) & B[c]) | (D & L[c])``, the carry
going from word to word (Shift-And). A whole batch of URLs steps together, one column of bytes at
a time, longest URLs first, so a step touches only URLs that still have bytes; it ends early when
no state can change any more. Rules beyond ``WORDS`` words are simulated in further blocks, and
tables are compiled inside tasks from the rules' text.

Globs, over UTF-8: ``*`` any run without ``/``; ``**`` any run; ``?`` one character other than
``/``; ``[abc]``, ``[a-z]``, ``[!...]`` one character of a class (ASCII members); ``\\`` escapes.

``host_rules`` turns (action, host, path) lists into globs that fit a host, all its subdomains and
paths with that prefix.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path follows up to ``?``, ``#`` or the end. A null URL and one without ``://`` have
both empty. Among fitting rules the listed ones (with a name) win over the unnamed ones, then the
longest name, then ``block``, then the first; no fitting rule leaves the default. Rows are judged one
by one, so repeated rows and null ids pass through; other columns stay, except those that carry the
names of results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.llm.common import process_cache, text_bytes

WORDS = 64  # 64-bit words of states simulated together
BATCH_BYTES = 4 << 20  # bytes of URLs that step together
SETTLE = 32  # steps between looks for URLs whose result is fixed
_U = np.uint64
_MORE = slice(0x80, 0xC0)  # bytes that continue a character


@dataclass(frozen=True)
class Rule:
    glob: str
    action: str
    name: str | None = None


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?[]\\" else c for c in text)


def host_rules(listed: Sequence[tuple[str, str, str]]) -> list[Rule]:
    """Rules for (action, host, path): the host, its subdomains, every path with this prefix."""
    out = []
    for action, host, path in listed:
        own = f"*.{escape(host)}"
        if path and not path.startswith("/"):
            raise ValueError(f"a rule's path starts with /, not {path!r}")
        ends = [escape(path) + "**"] if path else ["", "/**"]  # the host ends there
        out += [Rule(own + end, action, host + path) for end in ends]
    return out


def _bytes_of(char: str) -> list[np.ndarray]:
    out = []
    for b in char.encode():
        own = np.zeros(256, bool)
        own[b] = True
        out.append(own)
    return out


def _class(glob: str, i: int) -> tuple[np.ndarray, int]:
    """The bytes of a ``[...]`` class that opens at i, and the place after it."""
    end = glob.find("]", i + (3 if glob[i + 1:i + 2] == "!" else 2))
    if end < 0:
        raise ValueError(f"class without end in glob {glob!r}")
    inside = glob[i + 1:end]
    negated = inside.startswith("!")
    inside = inside[negated:]
    if not inside.isascii():
        raise ValueError(f"class with members beyond ASCII in glob {glob!r}")
    own, j = np.zeros(256, bool), 0
    while j < len(inside):
        if inside[j + 1:j + 2] == "-" and j + 2 < len(inside):
            own[ord(inside[j]):ord(inside[j + 2]) + 1] = True
            j += 3
        else:
            own[ord(inside[j])] = True
            j += 1
    if negated:
        own = ~own
        own[_MORE] = False
    return own, end + 1


def parse(glob: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bytes that enter each state after the start, and bytes that each state stays in."""
    enter: list[np.ndarray] = []
    stay = [np.zeros(256, bool)]
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            anything = glob[i:i + 2] == "**"
            loop = np.ones(256, bool)
            loop[ord("/")] = anything
            stay[-1] = stay[-1] | loop
            i += 1 + anything
            continue
        if c == "?":
            own = np.ones(256, bool)
            own[_MORE], own[ord("/")] = False, False
            steps, i = [own], i + 1
        elif c == "[":
            own, i = _class(glob, i)
            steps = [own]
        else:
            if c == "\\" and i + 1 < len(glob):
                i, c = i + 1, glob[i + 1]
            steps, i = _bytes_of(c), i + 1
        wide = len(steps) == 1 and bool(steps[0][0xC0:].any()) and c in "?["
        for own in steps:
            enter.append(own)
            stay.append(np.zeros(256, bool))
        if wide:  # the rest of a character of several bytes
            stay[-1][_MORE] = True
    return enter, stay


class Automaton:
    """Masks of a block of globs that fits into some words; state 0 of a glob is its start."""

    def __init__(self, globs: Sequence[tuple[list[np.ndarray], list[np.ndarray]]]):
        sizes = [len(stay) for _, stay in globs]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        words = max(1, -(-int(first[-1]) // 64))
        enter, stay = np.zeros((256, words * 64), bool), np.zeros((256, words * 64), bool)
        for at, (e, s) in zip(first, globs, strict=False):
            if e:
                enter[:, at + 1:at + 1 + len(e)] = np.stack(e, axis=1)
            stay[:, at:at + len(s)] = np.stack(s, axis=1)
        self.enter, self.stay = _packed(enter), _packed(stay)
        begin = np.zeros((1, words * 64), bool)
        begin[0, first[:-1]] = True
        self.begin = _packed(begin)[0]
        self.last = first[1:] - 1
        # states that no byte can leave or end, and that lead nowhere: the result is fixed there
        fixed = stay.all(axis=0)[None] & ~np.roll(enter.any(axis=0), -1)[None]
        self.moving = ~_packed(fixed)[0]

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit each whole text, a matrix of texts x globs."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        buffer = np.frombuffer(b"".join([*texts, b"\0"]), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        lengths = lengths[order]
        d = np.repeat(self.begin[None], len(texts), axis=0)
        live = np.arange(len(texts))  # places in ``order`` that still step, longest first
        step = 0
        while len(live):
            n = np.searchsorted(-lengths[live], -step, side="left")  # those longer than ``step``
            live = live[:n]
            if step % SETTLE == SETTLE - 1 and n:
                live = live[(d[live] & self.moving).any(axis=1)]
            if not len(live):
                break
            c = buffer[starts[live] + step]
            own = d[live]
            up = own << _U(1)
            up[:, 1:] |= own[:, :-1] >> _U(63)
            d[live] = (up & self.enter[c]) | (own & self.stay[c])
            step += 1
        out = np.empty((len(texts), len(self.last)), bool)
        out[order] = (d[:, self.last // 64] >> (self.last % 64).astype(_U)) & _U(1) > 0
        return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as little-endian words."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(_U)


def blocks(globs: Sequence[str]) -> Iterator[tuple[int, Automaton]]:
    """(first rule, automaton) of consecutive rules that fit into ``WORDS`` words together."""
    own, begun, size = [], 0, 0
    for i, glob in enumerate(globs):
        parsed = parse(glob)
        if own and size + len(parsed[1]) > WORDS * 64:
            yield begun, Automaton(own)
            own, begun, size = [], i, 0
        own.append(parsed)
        size += len(parsed[1])
    if own:
        yield begun, Automaton(own)


def best_rule(texts: list[bytes], compiled: list[tuple[int, Automaton]], rank: np.ndarray) -> np.ndarray:
    """The fitting rule of least rank for every text, -1 for none; texts in groups of bounded bytes."""
    best = np.full(len(texts), -1)
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= BATCH_BYTES) and hi - lo < 8192:
            total += len(texts[hi])
            hi += 1
        least = np.full(hi - lo, len(rank))
        for first, automaton in compiled:
            fits = automaton.run(texts[lo:hi])
            own = np.where(fits, rank[first:first + fits.shape[1]], len(rank))
            least = np.minimum(least, own.min(axis=1, initial=len(rank)))
        best[lo:hi] = np.where(least < len(rank), np.append(np.argsort(rank), -1)[least], -1)
        lo = hi
    return best


def ranked(rules: Sequence[Rule]) -> np.ndarray:
    """Place of each rule in the order in which fitting rules win."""
    order = sorted(range(len(rules)), key=lambda i: (
        rules[i].name is None, -len(rules[i].name or rules[i].glob), rules[i].action != "block", i))
    out = np.empty(len(rules), np.int64)
    out[order] = np.arange(len(rules))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*+)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the name of the winning listed rule) and verdict."""
    results = ("host", "path", "rule", "verdict")
    url = pages["url"]
    kept = [c for c in pages.columns if c not in results]
    plain = pages.select(*[pages[c] for c in kept], host_of(url).alias("host"), path_of(url).alias("path"))
    rules = list(rules)
    globs, rank = [r.glob for r in rules], ranked(rules)
    # place len(rules) stands for "none": Arrow takes it as the last entry
    names = [r.name for r in rules] + [None]
    actions = [r.action for r in rules] + [default]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("url_automata")
        if cache.get("globs") != globs:
            cache.update(globs=globs, compiled=list(blocks(globs)))
        for b in batches:
            texts = [b"." + h + p for h, p in zip(text_bytes(b["host"]), text_bytes(b["path"]), strict=True)]
            won = best_rule(texts, cache["compiled"], rank)
            at = pa.array(np.where(won < 0, len(names) - 1, won))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()).take(at), pa.array(actions, pa.string()).take(at)],
                names=[*b.schema.names, "rule", "verdict"])
    return plain.mapInArrow(run, _with_results(plain))


def _with_results(plain: DataFrame):
    from pyspark.sql.types import StringType, StructType
    schema = StructType(list(plain.schema.fields))
    return schema.add("rule", StringType()).add("verdict", StringType())
