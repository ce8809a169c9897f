"""Documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawscan.llm.common import shared_folder, unused
from rawscan.llm.decontaminate import remove_contaminated
from rawscan.llm.language_id import keep_identified
from rawscan.llm.line_spread import remove_boilerplate
from rawscan.llm.sentencepiece_codec import encode_documents
from rawscan.llm.simhash_tables import keep_one

WORDS, RADIUS, SIMILARITY = 5, 3, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines stay in their first document only; documents that lose all they had go."""
    cut, removed = remove_boilerplate(docs), F.col(unused(docs, "__removed"))
    rest = cut.where((removed == 0) | F.col("text").rlike(r"[^ \n]"))
    changed = F.when(removed > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rest.select(*[changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links at 3 bits through the vantage-point tree, and by similarity, on shingles of five words."""
    return keep_one(docs, words=WORDS, radius=RADIUS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, decoded again as a check."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None  # trained models and fingerprints are not for SQL; tests hold a brute-force version against it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
