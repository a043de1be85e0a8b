"""Patterns as the rules state them, in ECMAScript syntax, put into Java's (for Spark) or RE2's (for the SQL oracle).

The engines differ where patterns meet text that isn't ASCII: word boundaries, white space, and what a dot matches.
"""

from __future__ import annotations

import re

WORD = "A-Za-z0-9_"
#: What \s means in ECMAScript: the engines' own \s is narrower.
SPACE = {
    "java": r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF",
    "re2": r" \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}",
}
DOT = {"java": r"[^\n\r\u2028\u2029]", "re2": r"[^\n\r\x{2028}\x{2029}]"}


def translate(pattern: str, engine: str, ignore_case: bool = False) -> str:
    """``engine``: java or re2. Java's \\b looks at all letters, so it becomes an explicit test for ASCII word characters."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two, i = pattern[i : i + 2], i + 2
            if two == r"\s":
                out.append(SPACE[engine] if inside else f"[{SPACE[engine]}]")
            elif two == r"\b" and not inside and engine == "java":
                leading = not out and re.match(r"\(*(\?:)?[A-Za-z0-9\\\[]", pattern[i:]) and "#" not in pattern
                out.append(f"(?<![{WORD}])(?=[{WORD}])" if leading else f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
            else:
                out.append({r"\-": r"\-", r"\/": "/", r"\<": "<", r"\>": ">"}.get(two, two))
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(DOT[engine] if c == "." and not inside else c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def any_of(phrases: list[str] | tuple[str, ...]) -> str:
    """Alternation of literal phrases, in their order."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in phrases)


def quoted(text: str) -> str:
    """A SQL string literal for the oracle."""
    return "'" + text.replace("'", "''") + "'"
