"""Raw filters: substring tests on unparsed records, below any parser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.literals import is_sound_token

MAX_TERMS = 32


def rf(value: Column, token: str, mode: str = "exact") -> Column:
    """Exact mode lets records pass that may hide the token behind an escape."""
    hit = value.contains(token)
    if mode == "raw":
        return hit
    if not is_sound_token(token):
        return F.lit(True)
    return hit | value.contains("\\" if "/" in token else "\\u")


def cascade(value: Column, tokens: list[str], mode: str = "exact") -> Column:
    """Conjunction in schedule order (short-circuiting in codegen); empty passes all."""
    return reduce(lambda a, b: a & b, [rf(value, t, mode) for t in tokens], F.lit(True))


def any_cascade(value: Column, branches: list[list[str]], mode: str = "exact") -> Column:
    """Disjunction: sound if each branch has its own cascade."""
    return reduce(lambda a, b: a | b, [cascade(value, b, mode) for b in branches], F.lit(False))


def apply_cascade(raw: DataFrame, tokens: list[str], value: str = "value", mode: str = "exact") -> DataFrame:
    for t in tokens:
        raw = raw.filter(rf(F.col(value), t, mode))
    return raw


class TermList:
    """A hand-built cascade with the classic limits: terms cut to 16 characters, 32 at most."""

    def __init__(self, limit: int | None = 16, most: int = MAX_TERMS):
        self.terms: list[str] = []
        self.limit, self.most = limit, most

    def add(self, term: str) -> int:
        """The count after adding, or -1 where the list is full."""
        if len(self.terms) >= self.most:
            return -1
        self.terms.append(term if self.limit is None else term[: self.limit])
        return len(self.terms)
