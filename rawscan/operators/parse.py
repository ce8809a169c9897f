"""Parse each surviving record once, strictly, and keep it where it is one JSON object.

The record is wrapped in brackets and parsed behind a generator: Catalyst cannot
pull later filters through it, so the plan holds a single ``from_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsonquery import JsonQuery

OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
PARSED = "__parsed"


def parse(raw: DataFrame, schema: T.StructType, value: str = "value", strict: bool = False) -> DataFrame:
    """``raw`` with a struct column PARSED; malformed records and all but single objects go.

    strict also refuses ``<object>] junk``, at the price of a second parse of the survivors.
    """
    wrapped = F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), T.ArrayType(schema), OPTIONS)
    out = raw.select("*", F.inline(F.array(F.struct(wrapped.alias("__records")))))
    out = out.filter((F.size("__records") == 1) & F.get("__records", F.lit(0)).isNotNull())
    if strict:
        boxed = F.from_json(F.concat(F.lit('{"r":'), F.col(value), F.lit("}")), T.StructType([T.StructField("r", schema)]), OPTIONS)
        out = out.filter(boxed.getField("r").isNotNull())
    return out.withColumn(PARSED, F.get("__records", F.lit(0))).drop("__records")


def execute(raw: DataFrame, query: JsonQuery, value: str = "value", strict: bool = False, strategy: str = "struct") -> DataFrame:
    """Rows of ``raw`` that the query accepts, with its projections added.

    strategy "path" reads each path with get_json_object instead: the first of repeated
    keys wins and trailing junk is let through; for single, trusted paths.
    """
    if not query.root.children:
        return raw.filter(F.lit(False))
    if strategy == "path":
        return _execute_paths(raw, query, value)
    out = parse(raw, query.schema(), value, strict)
    record = F.col(PARSED)
    return out.filter(query.condition(record)).select(*raw.columns, *query.columns(record))


def accepts(query: JsonQuery, value: str = "value") -> Column:
    """The query's verdict on a record as one Column, where counters need it for records that fail, too."""
    records = F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), T.ArrayType(query.schema()), OPTIONS)
    return (F.size(records) == 1) & query.condition(F.get(records, F.lit(0)))


def execute_files(spark: SparkSession, path, query: JsonQuery, delimiter: str = "\n") -> DataFrame:
    """The query's projections for the records of JSON files, through Spark's JSON reader: no raw filter, and the text is not kept.

    As the reader has it, a record may have junk behind its object."""
    if not query.root.children:
        raise ValueError("a query without paths accepts nothing")
    rows = spark.read.schema(query.schema()).options(mode="DROPMALFORMED", lineSep=delimiter, **OPTIONS).json(path)
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    found = rows.select(record.alias(PARSED)).filter(query.condition(F.col(PARSED)))
    return found.select(*query.columns(F.col(PARSED)))


def _execute_paths(raw: DataFrame, query: JsonQuery, value: str) -> DataFrame:
    casts = {"int": "bigint", "bool": "boolean", "double": "double"}

    def read(path: str, kind: str):
        text = F.get_json_object(F.col(value), "$." + path)
        return text.try_cast(casts[kind]) if kind in casts else text

    for path, node in query._leaves():
        col = read(".".join(path), node.kind)
        for p in node.predicates:
            raw = raw.filter(p(col))
        if node.exists:
            raw = raw.filter(col.isNotNull())
    kinds = {".".join(p): n.kind for p, n in query._leaves()}
    return raw.select("*", *[read(path, kinds[path]).alias(name) for name, path in query.projections.items()])
