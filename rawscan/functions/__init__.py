"""Column functions: bitmaps, lane counts, number formats."""

from .bitmaps import bitmap_capacity, bitmap_joint_count, bitmap_of, get_bit, set_count
from .lanes import lane_count

__all__ = ["bitmap_capacity", "bitmap_joint_count", "bitmap_of", "get_bit", "lane_count", "set_count"]
