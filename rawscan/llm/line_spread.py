"""Cross-site boilerplate: lines on many distinct sites, found by merged HyperLogLog sketches.

One aggregation gives each line (by 128 bits of hash) a sketch of its sites. Estimates far
from the threshold decide; lines near it get an exact distinct count. A boilerplate line
stays in the document with the least id that has it and goes from all others.

Defined results: lines are cut at "\\n" and compared whole; blank lines always stay; a null
site counts as the site ''; a null text has no lines and stays null; equal rows lose the same
lines; a line of null-id rows only is kept by those; a document may end up empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

MIN_SITES = 3
LG_K = 8  # 2**LG_K registers; relative error 1.04 / 2**(LG_K / 2)
ERRORS = 4  # this many standard errors around the threshold count as near


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.split(text, "\n", -1).alias("lines"))
    lines = rows.select("id", "text_hash", "site", F.posexplode("lines").alias("pos", "line")).where(F.trim("line") != "")
    return lines.select("id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, keeper): hashes of lines on at least ``min_sites`` distinct sites and the id that keeps each."""
    lines = _lines(docs, id_col, text_col, site_col)
    band = max(1, math.ceil(ERRORS * 1.04 / 2 ** (lg_k / 2) * min_sites))
    sketched = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    wide = stored(sketched.where(F.col("sites") >= max(2, min_sites - band)), "line-sites")
    near = wide.where(F.col("sites") <= min_sites + band)
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    sure = wide.where(F.col("sites") > min_sites + band).select("h1", "h2", "keeper")
    return sure.unionAll(near.join(exact, ["h1", "h2"]).select("h1", "h2", "keeper"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """``docs`` with the text rewritten and two columns more: __lines and __removed (bigint), named by ``unused``."""
    found = stored(boilerplate(docs, min_sites, id_col, text_col, site_col, lg_k), "line-boilerplate")
    hits = _lines(docs, id_col, text_col, site_col).join(found, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    its_id, its_hash, places, cut = (unused(docs, c) for c in ("__id", "__text_hash", "__positions", "__lines_array"))
    per_row = hits.groupBy(F.col("id").alias(its_id), F.col("text_hash").alias(its_hash)).agg(F.collect_set("pos").alias(places))
    joined = docs.join(per_row, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.xxhash64(text_col) == F.col(its_hash)), "left")
    out = joined.withColumn(cut, F.split(F.col(text_col), "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(places))
    kept = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col(cut), i)), "\n"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("bigint")
    return out.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns], size(cut).alias(unused(docs, "__lines")), size(places).alias(unused(docs, "__removed")))


def op9_line_spread(spark, sf_dir):
    out = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.md5("text").alias("kept_md5"))


SQL_CLEAN = """lines AS (SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
spread AS (SELECT line, min(doc_id) AS keeper FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= 3),
cut AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(s.line) AS n_removed,
coalesce(string_agg(CASE WHEN s.line IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
FROM lines l LEFT JOIN spread s ON l.line = s.line AND l.doc_id <> s.keeper GROUP BY l.doc_id, l.text)"""
SQL = "WITH " + SQL_CLEAN.format(docs="documents") + " SELECT doc_id, n_lines, n_removed, md5(kept) AS kept_md5 FROM cut"
