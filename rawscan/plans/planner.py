"""Choose the cascade of raw filters with the least expected cost on a sample.

One small Spark job evaluates every candidate on the sample and returns the count of
each hit pattern (at most ``sample_rows`` rows); the search over schedules is then
plain Python on integer bit masks.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .decompose import RawFilter, decompose, limit_fairly

SAMPLE_ROWS = 1000
MAX_FILTERS = 32
MAX_DEPTH = 4
PARSE_SAMPLES = 10
CYCLES_PER_BYTE = 8.0
CYCLES_PER_NS = 3.0


def filter_cost(token: str) -> float:
    return CYCLES_PER_BYTE * len(token)


@dataclass(frozen=True)
class Schedule:
    indexes: tuple[int, ...]
    cost: float


@dataclass(frozen=True)
class Plan:
    tokens: list[str]
    schedule: Schedule
    filters: list[RawFilter]
    sampled: int
    parse_cost: float
    processed: int
    skipped: int
    timings: dict = field(default_factory=dict, compare=False)


def hit_patterns(raw: DataFrame, filters: list[RawFilter], value: str = "value") -> dict[int, int]:
    """Bit i of a pattern is set where the record contains filter i's token."""
    mask = F.lit(0).cast("bigint")
    for i, f in enumerate(filters):
        mask = mask.bitwiseOR(F.when(F.col(value).contains(f.token), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return {r["mask"]: r["n"] for r in raw.select(mask.alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).collect()}


def joint_rate(patterns: dict[int, int], indexes: tuple[int, ...]) -> float:
    """Share of sampled records that hold all the tokens (true correlation, no independence assumed)."""
    want, total = sum(1 << i for i in indexes), sum(patterns.values())
    return sum(n for mask, n in patterns.items() if mask & want == want) / total if total else 1.0


def schedule_cost(filters: list[RawFilter], indexes: tuple[int, ...], patterns: dict[int, int], parse_cost: float) -> float:
    cost, reach = 0.0, 1.0
    for k, i in enumerate(indexes):
        cost += filter_cost(filters[i].token) * reach
        reach = joint_rate(patterns, indexes[: k + 1])
    return cost + parse_cost * reach


def enumerate_schedules(filters: list[RawFilter], max_depth: int = MAX_DEPTH, empty: bool = True):
    """Index combinations by size, one filter per source; also the count of those skipped."""
    valid: list[tuple[int, ...]] = [()] if empty else []
    skipped = 0
    for size in range(1, min(max_depth, len(filters)) + 1):
        for combo in combinations(range(len(filters)), size):
            if len({filters[i].source for i in combo}) == size:
                valid.append(combo)
            else:
                skipped += 1
    return valid, skipped


def choose(filters, patterns, parse_cost, max_depth=MAX_DEPTH, policy="min_cost", empty=True):
    """min_cost: least (cost, size, indexes). last_valid: the last one enumerated, for comparison."""
    valid, skipped = enumerate_schedules(filters, max_depth, empty)
    costed = [Schedule(c, schedule_cost(filters, c, patterns, parse_cost)) for c in valid]
    if not costed:
        return Schedule((), parse_cost), 0, skipped
    best = costed[-1] if policy == "last_valid" else min(costed, key=lambda s: (s.cost, len(s.indexes), s.indexes))
    return best, len(costed), skipped


def measure_parse_cost(records: list[str], spark: SparkSession | None = None, schema: StructType | None = None, repeat: int = 500) -> float:
    """Cycles to parse one record, as the mean of a few; unparsable records count too.

    With a schema, of Spark's parser in one task: the seconds that ``from_json`` adds to ``repeat`` passes over the records.
    Without, of Python's parser, as a stand-in."""
    if not records:
        return 0.0
    if schema is not None:
        rows = spark.createDataFrame([(r,) for r in records], "value string").coalesce(1)
        rows = rows.select("value", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("pass"))
        text = F.concat(F.lit("["), "value", F.lit("]"))

        def seconds(column) -> float:
            begun = time.perf_counter()
            rows.select(F.sum(F.coalesce(F.length(column), F.lit(0)) + F.col("pass"))).collect()
            return time.perf_counter() - begun

        first = F.get(F.from_json(text, ArrayType(schema)), F.lit(0))
        kept = F.to_json(F.struct(first.isNull()))
        for column in (text, kept):
            seconds(column)  # compiled once
        return max(seconds(kept) - seconds(text), 0.0) * 1e9 / (len(records) * repeat) * CYCLES_PER_NS
    begun = time.perf_counter_ns()
    for r in records:
        try:
            json.loads(r)
        except ValueError:
            pass
    return (time.perf_counter_ns() - begun) / len(records) * CYCLES_PER_NS


def random_rows(raw: DataFrame, rows: int, seed: int) -> DataFrame:
    """Some ``rows`` rows or a few more at random, without a sort: by a count and a Bernoulli sample."""
    total = raw.count()
    return raw if total <= rows else raw.sample(min(1.0, (rows + 4 * rows**0.5) / total), seed)


def calibrate(
    raw: DataFrame,
    terms: list[str],
    value: str = "value",
    sample_rows: int = SAMPLE_ROWS,
    parse_cost: float | None = None,
    sample: str = "head",
    policy: str = "min_cost",
    max_filters: int = MAX_FILTERS,
    max_depth: int = MAX_DEPTH,
    seed: int = 42,
    schema: StructType | None = None,
) -> Plan:
    """The cheapest cascade for ``terms`` on a sample of ``raw``; the empty cascade competes too. ``schema``: what the query parses."""
    begun = time.perf_counter()
    filters = limit_fairly(decompose(terms), min(max_filters, 62))
    head = (random_rows(raw.select(value), sample_rows, seed) if sample == "random" else raw.select(value)).limit(sample_rows)
    if parse_cost is None:
        parse_cost = measure_parse_cost([r[0] for r in head.limit(PARSE_SAMPLES).collect() if r[0] is not None], raw.sparkSession, schema)
    parsed = time.perf_counter()
    patterns = hit_patterns(head, filters, value)
    grepped = time.perf_counter()
    best, processed, skipped = choose(filters, patterns, parse_cost, max_depth, policy)
    timings = {"parse_s": parsed - begun, "grep_s": grepped - parsed, "search_s": time.perf_counter() - grepped}
    tokens = [filters[i].token for i in best.indexes]
    return Plan(tokens, best, filters, sum(patterns.values()), parse_cost, processed, skipped, timings)
