"""Typed leaf predicates and the literals that every matching record must contain.

A predicate builds a Catalyst ``Column`` for the exact check.  ``literal`` is a
substring that a passing record is bound to hold (before JSON escaping), or None
where no sound literal exists: ranges, negations and arbitrary user functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    build: Callable[[Column], Column]
    literal: str | None = None
    name: str = "custom"

    def __call__(self, value: Column) -> Column:
        return self.build(value)


def contains(s: str) -> Predicate:
    return Predicate(lambda c: c.contains(s), s, f"contains({s!r})")


def startswith(s: str) -> Predicate:
    return Predicate(lambda c: c.startswith(s), s, f"startswith({s!r})")


def endswith(s: str) -> Predicate:
    return Predicate(lambda c: c.endswith(s), s, f"endswith({s!r})")


def equals(s: str | int | bool) -> Predicate:
    return Predicate(lambda c: c == F.lit(s), s if isinstance(s, str) else None, f"equals({s!r})")


def custom(build: Callable[[Column], Column]) -> Predicate:
    """Any boolean Column builder or UDF; yields no raw filter."""
    return Predicate(build)


def as_predicate(p) -> Predicate:
    return p if isinstance(p, Predicate) else custom(p)


def is_sound_token(token: str) -> bool:
    """A quote, a backslash or a control character is always escaped in JSON text."""
    return bool(token) and not any(ch in '"\\' or ord(ch) < 0x20 for ch in token)
