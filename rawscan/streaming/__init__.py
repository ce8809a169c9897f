"""The same search on streams: per-record filters without state."""

from .stream import recalibrating_writer, search_stream

__all__ = ["recalibrating_writer", "search_stream"]
