"""Search: raw-filter cascade, then one parse of the survivors, then the exact predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan, calibrate
from .jsonquery import JsonQuery
from .parse import accepts, execute
from .rawfilter import apply_cascade, rf


def search(raw: DataFrame, query: JsonQuery, tokens: list[str] | None = None, value: str = "value", raw_filter: bool = True, mode: str = "exact", strict: bool = False) -> DataFrame:
    """``tokens`` is a schedule (default: each whole literal of the query)."""
    if raw_filter:
        raw = apply_cascade(raw, query.literals() if tokens is None else tokens, value, mode)
    return execute(raw, query, value, strict)


def calibrated_search(raw: DataFrame, query: JsonQuery, value: str = "value", sample_from: DataFrame | None = None, **options) -> tuple[DataFrame, Plan | None]:
    """Plan the cascade on a sample, then search. Without literals there is nothing to plan."""
    terms = query.literals()
    if not terms:
        return search(raw, query, [], value), None
    plan = calibrate(sample_from if sample_from is not None else raw, terms, value, **{"schema": query.schema()} | options)
    return search(raw, query, plan.tokens, value), plan


def search_where(raw: DataFrame, tokens: list[str], predicate: Column, value: str = "value", mode: str = "raw") -> DataFrame:
    """Search with any boolean Column in the place of a JSON query (a Python UDF is evaluated after the cascade)."""
    return apply_cascade(raw, tokens, value, mode).filter(predicate)


def for_each_match(matches: DataFrame, action) -> None:
    """Side effects on matches: ``action`` gets an iterator of rows per partition, at least once each."""
    matches.foreachPartition(action)


def stats(raw: DataFrame, tokens: list[str], exact: Column, value: str = "value") -> DataFrame:
    """One row of run counters in a single pass with map-side partial aggregation."""
    hits = [rf(F.col(value), t, "raw") for t in tokens]
    prefixes, so_far = [], F.lit(True)
    for h in hits:
        so_far = so_far & h
        prefixes.append(so_far)
    total = sum((F.coalesce(p.cast("bigint"), F.lit(0)) for p in prefixes), F.lit(0).cast("bigint"))
    passed = F.coalesce(so_far, F.lit(False))
    out = raw.select(total.alias("t"), passed.alias("p"), (passed & F.coalesce(exact, F.lit(False))).alias("c")).agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("total_matches"),
        F.count_if("p").alias("rf_passed"),
        F.count_if("c").alias("callback_passed"),
    )
    share = F.col("callback_passed") / F.col("rf_passed")
    some = F.col("rf_passed") > 0
    return out.select(
        "*",
        F.when(some, share).otherwise(0.0).alias("fraction_passed_correct"),
        F.when(some, 1.0 - share).otherwise(0.0).alias("fraction_passed_incorrect"),
        F.lit(0).cast("bigint").alias("bytes_seeked_forward"),
        F.lit(0).cast("bigint").alias("bytes_seeked_backward"),
    )


def search_stats(raw: DataFrame, query: JsonQuery, tokens: list[str] | None = None, value: str = "value") -> DataFrame:
    """The run counters of a search: its raw filters, and the parsed query as the exact predicate of the survivors."""
    return stats(raw, query.literals() if tokens is None else tokens, accepts(query, value), value)


REPORT = [
    ("Records scanned", "records"),
    ("Prefix token hits", "total_matches"),
    ("Raw-filter survivors", "rf_passed"),
    ("Exact matches", "callback_passed"),
    ("Bytes skipped forward", "bytes_seeked_forward"),
    ("Bytes skipped backward", "bytes_seeked_backward"),
    ("Share of survivors correct", "fraction_passed_correct"),
    ("Share of survivors wrong", "fraction_passed_incorrect"),
]


def stats_report(stats_row: DataFrame) -> DataFrame:
    """The eight-line text report, one row per line, in order."""
    line = [F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(label + ": "), F.format_string("%.6f" if name.startswith("fraction") else "%d", F.col(name))).alias("line")) for i, (label, name) in enumerate(REPORT)]
    return stats_row.select(F.inline(F.array(*line)))
