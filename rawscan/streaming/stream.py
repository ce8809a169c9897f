from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.engine import calibrated_search, search
from ..operators.jsonquery import JsonQuery
from ..sources.text import read_records


def search_stream(spark: SparkSession, path: str, query: JsonQuery, tokens: list[str] | None = None, delimiter: str = "\n") -> DataFrame:
    """Streaming DataFrame of matches; one fixed schedule serves all micro-batches."""
    return search(read_records(spark, path, delimiter, streaming=True), query, tokens)


def recalibrating_writer(query: JsonQuery, sink: Callable[[DataFrame, int], None], every: int = 1, **options) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: plans anew every few batches. Only the cascade changes, never the matches."""
    kept: dict = {"tokens": None}

    def write(batch: DataFrame, batch_id: int) -> None:
        if kept["tokens"] is None or batch_id % every == 0:
            matches, plan = calibrated_search(batch, query, **options)
            kept["tokens"] = plan.tokens if plan else []
        else:
            matches = search(batch, query, kept["tokens"])
        sink(matches, batch_id)

    return write
