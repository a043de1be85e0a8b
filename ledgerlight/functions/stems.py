"""Literal stems: what a text must hold, in lower case, for a pattern to match at all.

A scan asks for these first, by plain substring search, and runs a rule's patterns only on texts that may match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most characters of a class that still count as stems of one character each, such as the digits.
FEW = 12
#: Most alternatives that a pattern tries one after another.
SIDES = 4


def _class(items: list) -> frozenset[str] | None:
    """The characters of a class, if they are ASCII and few."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is K.LITERAL:
            chars.add(chr(value))
        elif kind is K.RANGE and value[1] - value[0] < FEW:
            chars |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif kind is K.CATEGORY and value is K.CATEGORY_DIGIT:
            chars |= set("0123456789")
        else:
            return None
    few = frozenset(c.lower() for c in chars)
    return few if len(few) <= FEW and all(c.isascii() for c in few) else None


def _needs(sequence) -> frozenset[str] | None:
    """Of a sequence's parts that must match the one that tells most: one of its stems is in every match."""
    found, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        if kind is K.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind in (K.AT, K.ASSERT, K.ASSERT_NOT):  # take no characters, so what stands around them is adjacent
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if kind is K.IN:
            found.append(_class(value))
        elif kind is K.BRANCH:
            sides = [_needs(s) for s in value[1]]
            found.append(None if None in sides else frozenset().union(*sides))
        elif kind is K.SUBPATTERN:
            found.append(_needs(value[3]))
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
            found.append(_needs(value[2]))
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)


@lru_cache(maxsize=1024)
def stems(pattern: str) -> frozenset[str] | None:
    """Stems of which one at least is in the lower case of every match; None if there is no telling."""
    try:
        return _needs(_parser.parse(pattern))
    except re.error:
        return None


def stems_of(patterns: Iterable[str]) -> frozenset[str] | None:
    """Stems for a match of any of several patterns, without those that hold another."""
    each = [stems(p) for p in patterns]
    if None in each or not each:
        return None
    every = frozenset().union(*each)
    return frozenset(s for s in every if not any(o != s and o in s for o in every))


def holds_any(text: Column, some: frozenset[str]) -> Column:
    """Whether the lower case of ``text`` holds one of the stems. It is bound in a lambda, so that it is made once for all."""

    def tested(lower: Column) -> Column:
        tests = [F.contains(lower, F.lit(s)) for s in sorted(some)]
        while len(tests) > 1:  # balanced, so the expression stays shallow
            tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
        return tests[0]

    return F.exists(F.array(F.lower(text)), tested)


def _alternatives(some: Iterable[str]) -> str:
    """A pattern of several literals as a tree by their characters, which tries the longest first."""
    by_first: dict[str, list[str]] = {}
    for s in some:
        if s:
            by_first.setdefault(s[0], []).append(s[1:])
    return _halved([(c, re.escape(c) + (f"(?:{_alternatives(rest)})" + ("?" if "" in rest else "") if any(rest) else "")) for c, rest in sorted(by_first.items())])


def _halved(sides: list[tuple[str, str]]) -> str:
    """Alternatives by their first characters, in halves that a look at the next character tells apart: few are tried at a place."""
    if len(sides) <= SIDES:
        return "|".join(p for _, p in sides)
    halves = sides[: len(sides) // 2], sides[len(sides) // 2 :]
    return "|".join(f"(?=[\\x{ord(h[0][0]):02x}-\\x{ord(h[-1][0]):02x}])(?:{_halved(h)})" for h in halves)


def any_literal(phrases: Iterable[str]) -> str:
    """A pattern that matches where one of several ASCII phrases stands; which of them, it doesn't tell."""
    return _alternatives(phrases)


def held(text: Column, vocabulary: frozenset[str]) -> Column:
    """Of a vocabulary of stems those that the lower case of ``text`` holds, in one pass: at each place the longest one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({_alternatives(vocabulary)}))"), F.lit(1)))


def held_any(found: Column, vocabulary: frozenset[str], some: frozenset[str]) -> Column:
    """Whether what ``held`` found tells of one of the stems. Where a stem stands, a longer one that starts with it may be found."""
    telling = sorted(v for v in vocabulary if v.startswith(tuple(some)))
    return F.exists(found, lambda s: s.isin(*telling))  # a text holds few stems, each looked up in a set
