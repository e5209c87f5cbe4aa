"""Patterns with Python's Unicode meaning, spelled for Spark's Java engine.

Java's own ``\\s \\w \\d \\b`` are ASCII or, under ``(?U)``, differ in detail from
Python's and between JDK releases, so the classes are written out.
"""

from __future__ import annotations

import re

SPACE = (
    r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The complement is spelled as ranges too, printable ASCII first: Java tests a negated
# union about ten times slower.
NON_SPACE_WIDE = (
    r"\x80-\x84\x86-\x9F\xA1-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
)
NON_SPACE = rf"!-~[\x00-\x08\x0E-\x1B\x7F{NON_SPACE_WIDE}]"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

_MEMBERS = {"s": SPACE, "w": WORD, "d": DIGIT}
_TOKEN = re.compile(r"\\(.)|(\[\^?)|(\])", re.DOTALL)


def java(pattern: str) -> str:
    """Expand ``\\s \\S \\w \\d \\b`` in ``pattern``, inside and outside brackets."""
    inside = False

    def expand(m: re.Match) -> str:
        nonlocal inside
        escaped = m.group(1)
        if escaped is None:
            inside = m.group(2) is not None if not inside else m.group(3) is None
            return m.group(0)
        if escaped in _MEMBERS:
            return _MEMBERS[escaped] if inside else f"[{_MEMBERS[escaped]}]"
        if escaped == "S" and not inside:
            return f"[{NON_SPACE}]"
        if escaped == "b" and not inside:
            return f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
        return m.group(0)

    return _TOKEN.sub(expand, pattern)
