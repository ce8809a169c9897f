"""Search terms -> candidate raw filters: each whole term, then its 4-character windows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 4


@dataclass(frozen=True)
class RawFilter:
    token: str
    source: int


def decompose(terms: Iterable[str], gram: int = GRAM) -> list[RawFilter]:
    """Terms of ``gram`` characters or fewer give themselves only; duplicates stay."""
    out: list[RawFilter] = []
    for source, term in enumerate(terms):
        windows = [term[i : i + gram] for i in range(len(term) - gram + 1)] if len(term) > gram else []
        out += [RawFilter(t, source) for t in (term, *windows)]
    return out


def decompose_column(term: Column, gram: int = GRAM) -> Column:
    """The same decomposition of a string column, as an array column."""
    windows = F.transform(F.sequence(F.lit(1), F.length(term) - (gram - 1)), lambda i: F.substring(term, i, F.lit(gram)))
    return F.when(F.length(term) > gram, F.concat(F.array(term), windows)).otherwise(F.array(term))


def clamp(token: str, limit: int = 16) -> str:
    """A prefix of a required substring is itself required."""
    return token[:limit]


def limit_fairly(filters: list[RawFilter], most: int) -> list[RawFilter]:
    """At most ``most`` candidates, dealt round-robin over sources, in their original order."""
    if len(filters) <= most:
        return filters
    ranks: dict[int, int] = {}
    keyed = []
    for pos, f in enumerate(filters):
        ranks[f.source] = ranks.get(f.source, -1) + 1
        keyed.append((ranks[f.source], f.source, pos))
    keep = {pos for _, _, pos in sorted(keyed)[:most]}
    return [f for pos, f in enumerate(filters) if pos in keep]
