"""Bitmaps over positions: SQL aggregates for columns, Python integers on the driver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bitmap_of(position: Column, when: Column | None = None) -> Column:
    """Aggregate: bitmap of the positions (of one bucket) for which ``when`` holds."""
    bit = F.bitmap_bit_position(position)
    return F.bitmap_construct_agg(bit if when is None else F.when(when, bit))


def set_count(bitmap: Column) -> Column:
    return F.bitmap_count(bitmap)


def bitmap_joint_count(position: Column, *conditions: Column) -> Column:
    """Aggregate: number of positions for which all conditions hold."""
    joint = conditions[0]
    for c in conditions[1:]:
        joint = joint & c
    return F.bitmap_count(bitmap_of(position, joint))


def bitmap_capacity() -> int:
    """Positions that one bucket's bitmap has room for."""
    return 8 * 4096


def get_bit(value: Column, index: int) -> Column:
    return F.getbit(value, F.lit(index))


def bits_set(bits: int, *indexes: int) -> int:
    for i in indexes:
        bits |= 1 << i
    return bits


def bits_unset(bits: int, *indexes: int) -> int:
    for i in indexes:
        bits &= ~(1 << i)
    return bits


def bits_text(bits: int, width: int = 64) -> str:
    return format(bits, f"0{width}b")
