"""The registry, the pipeline stage by stage, and the subpackage's isolation."""

import ast
import os
import subprocess
import sys

import corpus_pipeline as P
import __spark_entry__ as E

from . import brute
from rawscan.llm import decontaminate, line_spread

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_registry():
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]


def test_stages(spark):
    """Each stage on all its predecessor kept, against plain versions of its rule."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in P.STAGES:
        from rawscan.llm.common import stored

        kept.append(stored(stage(spark, kept[-1], brute.SF), f"test-{name}"))
    start, identified, lined, single, clean, encoded = ([r.asDict() for r in k.collect()] for k in kept)
    assert all(k.columns == columns for k in kept[:-1])
    # language: documents of real prose stay, rows are unchanged
    by_id = {r["doc_id"]: r for r in start}
    assert all(by_id[r["doc_id"]] == r for r in identified) and len(identified) >= 0.95 * len(start)
    # lines
    sites, keeper = {}, {}
    for r in identified:
        for x in r["text"].split("\n"):
            sites.setdefault(x, set()).add(r["source"])
            keeper[x] = min(keeper.get(x, r["doc_id"]), r["doc_id"])
    want = {}
    for r in identified:
        lines = r["text"].split("\n")
        left = [x for x in lines if not x.strip(" ") or len(sites[x]) < line_spread.MIN_SITES or keeper[x] == r["doc_id"]]
        if left == lines or any(x.strip(" ") for x in left):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lined} == want and all(r["n_chars"] == len(r["text"]) for r in lined)
    # near copies: one of each group stays, clean texts stay
    sets = {r["doc_id"]: set(brute.shingles(r["text"], 5)) for r in lined}
    similar = lambda i, j: len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) or 1)
    left = {r["doc_id"] for r in single}
    ids = sorted(sets)
    for i in ids:
        near = max((similar(i, j) for j in ids if j != i), default=0)
        if near < 0.6:
            assert i in left
    exact = brute.components(ids, lambda i, j: sets[i] == sets[j])
    close = brute.components(ids, lambda i, j: similar(i, j) >= 0.9)
    for groups in (exact, close):
        for root in set(groups.values()):
            assert len(left & {i for i in ids if groups[i] == root}) <= 1
    # benchmark
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in single if any(t in decontaminate.normalise(r["text"]) for t in items)}
    gone = left - {r["doc_id"] for r in clean}
    assert held <= gone and len(gone - held) <= 0.02 * len(left)
    # pieces
    assert {r["doc_id"] for r in encoded} == {r["doc_id"] for r in clean} and all(r["decoded_equal"] for r in encoded)
    assert sorted(r.doc_id for r in P.run(spark, brute.SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in encoded)


def test_simhash_dedup_links_all_pairs_within_three_bits(spark):
    """Texts of one long refrain and few other words: near by all shingles, not by the distinct ones that the tables count."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text")
    refrains = [(10**6 + 10 * g + k, f"this is verse {g} of a very long song " * 100 + " ".join(f"tail{g}x{k}x{i}" for i in range(12))) for g in range(5) for k in range(4)]
    docs = docs.unionAll(spark.createDataFrame(refrains, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute.simhash(t, P.WORDS) for i, t in texts.items()}
    close = brute.components(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert all(close[10**6 + 10 * g + k] == 10**6 + 10 * g for g in range(5) for k in range(4))
    left = {r.doc_id for r in P.simhash_dedup(spark, docs, brute.SF).collect()}
    assert all(i not in left for i, root in close.items() if i != root)
    assert left >= {10**6 + 10 * g for g in range(5)}
    assert left == {r.doc_id for r in P.keep_one(docs, words=P.WORDS, similarity=P.SIMILARITY).collect()} - {i for i, root in close.items() if i != root}


def test_stages_take_edges(spark):
    rows = brute.edge_rows()
    docs = brute.with_clashes(spark.createDataFrame(rows, brute.DOCS))
    for _, stage in P.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, brute.SF)
            assert out.count() <= len(rows)
            if stage is not P.sentencepiece:
                assert out.columns == docs.columns


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "rawscan")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in top:
                with open(os.path.join(top, n)) as f:
                    found = [x for x in ast.walk(ast.parse(f.read())) if isinstance(x, ast.Import | ast.ImportFrom)]
                assert not any("llm" in (getattr(x, "module", "") or "") or any("llm" in a.name for a in x.names) for x in found), n


def test_the_rest_works_without_it(tmp_path):
    import shutil

    for n in ("__spark_entry__.py", "rawscan"):
        at = os.path.join(ROOT, n)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / n)
    shutil.rmtree(tmp_path / "rawscan" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
