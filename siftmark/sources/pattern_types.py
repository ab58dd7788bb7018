"""Kinds of patterns a rule may have, as tests in columns.

A kind gives a line test (does this line hit?) and may give a file test, a cheap one that holds for every text
with a hitting line. Kinds that can be written as a regular expression give that instead: their patterns are
data of the scan's plan. `register` adds own kinds:

    register(PatternType("max_length", line=lambda p, line: F.length(line) > p.max))

Packs name the kind in `pattern.type`. Rules of a kind that nobody registered load, but find nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column

from siftmark.functions.dialect import Translated, translate

_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")


@dataclass(frozen=True)
class Pattern:
    type: str = ""
    match: str = ""
    max: int = 0
    negate: bool = False


@dataclass(frozen=True)
class PatternType:
    """`line` and `file` make boolean columns of a pattern and a line or a whole text, `place` the 1-based byte
    column of a hit (1 without it). `translate` gives a regular expression in place of all three. `check` raises
    ValueError for a pattern that must not be used; a pattern that is not `usable` finds nothing."""

    name: str
    line: Callable[[Pattern, Column], Column] | None = None
    file: Callable[[Pattern, Column], Column] | None = None
    place: Callable[[Pattern, Column], Column] | None = None
    translate: Callable[[Pattern], Translated] | None = None
    check: Callable[[Pattern], None] | None = None
    usable: Callable[[Pattern], bool] = lambda pattern: True


@lru_cache(maxsize=4096)
def _translated(pattern: str) -> Translated:
    return translate(pattern)


_TYPES: dict[str, PatternType] = {}


def register(kind: PatternType) -> PatternType:
    """Make a kind known to all scans of this process; one of the same name is replaced."""
    if (kind.line is None) == (kind.translate is None):
        raise ValueError(f"pattern type {kind.name!r} needs either a line test or a translation")
    _TYPES[kind.name] = kind
    return kind


def unregister(name: str) -> None:
    _TYPES.pop(name, None)


def kind_of(pattern: Pattern) -> PatternType | None:
    """The kind of a pattern; None if it is unknown or the pattern cannot be used."""
    kind = _TYPES.get(pattern.type)
    return kind if kind is not None and kind.usable(pattern) else None


register(PatternType("regex", translate=lambda p: _translated(p.match), usable=lambda p: p.match != ""))
# A literal is the expression that matches just its characters.
register(PatternType("literal", translate=lambda p: _translated(_PUNCTUATION.sub(r"\\\g<0>", p.match)), usable=lambda p: p.match != ""))
