"""Held-out accuracy, the fusion's arithmetic, pages, edge cases."""

import math

import numpy as np

from . import brute
from rawscan.llm import language_id as L


def test_held_out_accuracy(spark):
    """Declarations of a third of the rows are hidden; texts alone must find them."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = {r.doc_id: r for r in L.identify(hidden).collect()}
    true = {r.doc_id: r.lang for r in docs.where("doc_id % 3 = 0 AND length(text) >= 200").collect()}
    assert np.mean([got[d].text_lang == lang for d, lang in true.items()]) > 0.97
    assert np.mean([got[d].kept for d in true]) > 0.97


def test_junk_is_rejected_and_prose_kept(spark):
    import random

    rng = random.Random(1)
    words = {"en": "the of and to in is that it was for on are with as his they".split(), "fr": "le de un et être à il avoir ne je son que se qui ce dans".split(), "de": "der die und in den von zu das mit sich des auf für ist im".split(), "es": "de la que el en y a los se del las un por con no una".split()}
    rows = [(100 * k + i, " ".join(rng.choices(w, k=120)), lang, "s", 0) for k, (lang, w) in enumerate(words.items()) for i in range(60)]
    rows += [(1000 + i, "".join(rng.choices("0123456789#@/\\|~^<>{}[]", k=600)), "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    # junk that is declared as English is a small part of what English is learnt from
    out = {r.doc_id: r for r in L.identify(docs).collect()}
    assert all(out[r[0]].lang_id == r[2] and out[r[0]].kept for r in rows if r[0] < 1000)
    clean = spark.createDataFrame([r if r[0] < 1000 else (r[0], r[1], None, "s", 0) for r in rows], brute.DOCS)
    assert {r.doc_id for r in L.keep_identified(clean).collect()} == {r[0] for r in rows if r[0] < 1000}


def test_fusion_arithmetic(spark):
    """Posterior of rows without text: declared and host evidence by hand."""
    text = {"en": "the cat sat on the mat and the dog ran", "fr": "le chat est sur la table et le chien court"}
    rows = [(i, text["en"] * 3, "en", "a", 0) for i in range(6)] + [(10 + i, text["fr"] * 3, "fr", "b", 0) for i in range(3)] + [(20, None, "fr", "a", 0), (21, None, None, "b", 0)]
    out = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, brute.DOCS), languages=("en", "fr"), alpha=2.0).collect()}
    assert all(out[r[0]].text_lang == r[2] for r in rows[:9])
    base = (np.array([6, 3, 0]) + 1) / 12
    suffix = (np.array([6, 3, 0]) + 2 * base) / (9 + 2)
    host = {"a": (np.array([6, 0, 0]) + 2 * suffix) / 8, "b": (np.array([0, 3, 0]) + 2 * suffix) / 5}
    p = host["a"] * np.array([1 - L.DECLARED_RIGHT, L.DECLARED_RIGHT, 0.5])
    assert math.isclose(out[20].posterior, max(p) / p.sum(), abs_tol=1e-6) and out[20].lang_id == "en" and out[20].text_lang is None and out[20].kept
    q = host["b"]
    assert math.isclose(out[21].posterior, max(q) / q.sum(), abs_tol=1e-6) and out[21].lang_id == "fr"


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = L.page_evidence(pages)
    out = L.identify(rows, suffix_col="suffix")
    assert out.count() == pages.count()
    agree = out.join(rows.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").selectExpr("avg(CAST(lang = lang_id AS int)) AS a").first().a
    assert agree > 0.95


def test_suffix_tips_the_language(spark):
    """Rows without text or declaration, by the suffix of their host; more texts are English."""
    text = {"en": "the cat sat on the mat and the dog ran", "de": "die Katze lag auf der Matte und der Hund lief"}
    rows = [(i, text["en"] * 3, "en", f"a{i}", 0) for i in range(8)] + [(10 + i, text["de"] * 3, "de", f"b{i}", 0) for i in range(6)]
    hosts = {20: "new.example.de", 21: "https://new.example.DE:80/x.fr", 22: "new.example.net", 23: "de", 24: None}
    rows += [(i, None, None, host, 0) for i, host in hosts.items()]
    out = {r.doc_id: r.lang_id for r in L.identify(spark.createDataFrame(rows, brute.DOCS)).collect()}
    assert {i: out[i] for i in hosts} == {20: "de", 21: "de", 22: "en", 23: "en", 24: "en"}


def test_pages_are_registered_with_their_suffix(spark):
    import __spark_entry__ as E

    pages = spark.read.parquet(f"{brute.SF}/pages.parquet")
    want = {tuple(r) for r in L.identify(L.page_evidence(pages), suffix_col="suffix").drop("text_hash").collect()}
    got = E.queries()["language_id_pages"](spark, brute.SF)
    assert got.columns[0] == "page_id" and {tuple(r) for r in got.collect()} == want and got.count() == pages.count()


def test_edges(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    out = L.identify(docs).collect()
    assert sorted(r.doc_id or -1 for r in out) == sorted(r[0] or -1 for r in rows)
    assert all(r.kept for r in out if r.doc_id in (1, 2))
    more = brute.with_clashes(docs)
    kept = L.keep_identified(more)
    assert kept.columns == more.columns and {1, 2} <= {r.doc_id for r in kept.collect()}
    assert L.identify(docs.limit(0)).collect() == [] and L.keep_identified(docs.limit(0)).collect() == []
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source")
    assert L.identify(unlabelled).count() == len(rows)
