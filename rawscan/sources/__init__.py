"""Record sources and sinks."""

from .text import byte_range, read_records, read_whole, sample_head, scratch_path, split_records, write_records

__all__ = ["byte_range", "read_records", "read_whole", "sample_head", "scratch_path", "split_records", "write_records"]
