"""A small prompt: run a catalogued query over a file with and without raw filters.

python -m rawscan.cli FILE
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .operators.engine import calibrated_search, search
from .operators.jsonquery import JsonQuery
from .plans.literals import contains
from .sources.text import read_records

CATALOGUE = [
    ("count of records whose text has both Trump and Putin", lambda: JsonQuery().add_string_filter("text", contains("Trump")).add_string_filter("text", contains("Putin"))),
]


def compare(raw, query: JsonQuery) -> dict:
    """Exact counts and seconds of both ways; they must agree."""
    begun = time.perf_counter()
    filtered, plan = calibrated_search(raw, query)
    with_rf = filtered.count()
    middle = time.perf_counter()
    without = search(raw, query, raw_filter=False).count()
    return {"raw_filter": with_rf, "parser_only": without, "raw_filter_s": middle - begun, "parser_only_s": time.perf_counter() - middle, "tokens": plan.tokens if plan else []}


def answer(raw, command: str, catalogue=None) -> str:
    catalogue = CATALOGUE if catalogue is None else catalogue
    command = command.strip()
    if command in ("queries", "help", ""):
        return "\n".join(f"{i}. {name}" for i, (name, _) in enumerate(catalogue, 1)) + "\nGive a number, or quit."
    if not command.isdigit() or not 1 <= int(command) <= len(catalogue):
        return f"no such query: {command}"
    r = compare(raw, catalogue[int(command) - 1][1]())
    return f"with raw filters {r['tokens']}: {r['raw_filter']} in {r['raw_filter_s']:.3f} s\nparser only: {r['parser_only']} in {r['parser_only_s']:.3f} s"


def main(argv: list[str]) -> int:
    if len(argv) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("rawscan").getOrCreate()
    raw = read_records(spark, argv[1])
    print(answer(raw, "queries"))
    while True:
        try:
            line = input("> ")
        except EOFError:
            return 0
        if line.strip() in ("quit", "exit"):
            return 0
        print(answer(raw, line))


if __name__ == "__main__":
    sys.exit(main(sys.argv))
