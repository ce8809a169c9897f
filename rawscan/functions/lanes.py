"""How many aligned lanes of a block equal a pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32


def lane_count(block: Column, pattern: str, block_size: int = BLOCK) -> Column:
    """Lanes as wide as the pattern (1, 2 or 4 characters) within the first ``block_size`` characters."""
    width = len(pattern)
    if width not in (1, 2, 4):
        raise ValueError("lanes are 1, 2 or 4 wide")
    starts = F.array(*[F.lit(i) for i in range(1, block_size + 1, width)])
    return F.size(F.filter(starts, lambda i: F.substring(block, i, F.lit(width)) == pattern))
