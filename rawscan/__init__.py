"""Predicate-driven scans of raw text records on Spark."""

from .operators.engine import calibrated_search, search, search_where, stats, stats_report
from .operators.jsonquery import JsonQuery
from .operators.parse import execute, parse
from .operators.rawfilter import TermList, any_cascade, apply_cascade, cascade
from .plans.decompose import RawFilter, decompose
from .plans.literals import contains, custom, endswith, equals, startswith
from .plans.planner import Plan, calibrate

__all__ = [
    "JsonQuery", "Plan", "RawFilter", "TermList", "any_cascade", "apply_cascade", "calibrate", "calibrated_search", "cascade", "contains", "custom",
    "decompose", "endswith", "equals", "execute", "parse", "search", "search_where", "startswith", "stats", "stats_report",
]
