"""The subpackage's queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import line_spread
from .decontaminate import op10_decontaminate
from .flat_graph import op7_flat_graph
from .language_id import language_id_pages, op3_language_id
from .line_spread import op9_line_spread
from .pii import op5_pii
from .secrets import op1_secrets
from .sentencepiece_codec import op2_sentencepiece
from .simhash_vptree import simhash_components
from .token_binary import round_trip
from .url_rules import op4_url_rules


def op2_digest(spark, sf_dir):
    return op2_sentencepiece(spark, sf_dir).drop("ids")


def op6_simhash(spark, sf_dir):
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_binary(spark, sf_dir):
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_sentencepiece": op2_digest,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_url_rules": op4_url_rules,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_flat_graph": op7_flat_graph,
    "op8_token_binary": op8_token_binary,
    "op9_line_spread": op9_line_spread,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE = {"op9_line_spread": line_spread.SQL}
