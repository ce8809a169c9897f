"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from . import brute
from rawscan.llm import flat_graph as G


def all_pairs(rows, threshold=0.93):
    """vec_id -> (links, component)."""
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (label, x / np.sqrt(x @ x))
    linked = lambda i, j: i in good and j in good and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= threshold
    ids = [r[0] for r in rows]
    comp = brute.components(ids, linked)
    return {i: (sum(j != i and linked(i, j) for j in ids), comp[i]) for i in ids}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    out = []
    for _ in range(150):
        c = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            out.append((c + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.25]), int(rng.integers(0, 2))))
    c = rng.normal(size=16)
    out += [(c + rng.normal(size=16) * 0.1, 1) for _ in range(200)]  # a dense group
    return [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(out)]


@pytest.mark.parametrize("shard", [2048, 128])
def test_recall_and_precision(spark, vectors, shard):
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")
    want = all_pairs(vectors)
    got = {r.vec_id: r for r in G.near_duplicates(df, shard=shard).collect()}
    assert set(got) == set(want)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert found >= 0.95 * sum(n for n, _ in want.values())
    exact = [i for i in want if (got[i].n_links, got[i].component_id) == want[i]]
    assert len(exact) >= 0.95 * len(want)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_table_matches_all_pairs(spark):
    df = spark.read.parquet(f"{brute.SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in G.near_duplicates(df).collect()} == all_pairs(rows)


def test_dense_groups_find_each_other():
    """Two groups of 200, cosine about 0.998 inside and 0.95 between, among 1,600 others."""
    rng = np.random.default_rng(4)
    a = G.unit(rng.normal(size=(1, 64)))
    side = rng.normal(size=(1, 64))
    side = G.unit(side - (side @ a.T) * a)
    near = lambda c: G.unit(c + rng.normal(size=(200, 64)) * 0.0055)
    x = np.concatenate([near(a), near(0.95 * a + (1 - 0.95**2) ** 0.5 * side), G.unit(rng.normal(size=(1600, 64)))])
    x = x[rng.permutation(len(x))]
    true = x @ x.T >= 0.93
    np.fill_diagonal(true, False)
    assert true.sum() > 0.9 * 400 * 399
    lists = G.build(x)
    i, d = np.nonzero(lists >= 0)
    found = np.zeros_like(true)
    for p, q in G.search(x, G.Graph.undirected(i, lists[i, d], len(x)), np.arange(len(x)), 0.93):
        found[p, q] = True
    assert not (found & ~true).any() and found.sum() >= 0.99 * true.sum()


def test_recall_that_falls_short_is_made_good(spark, vectors, monkeypatch):
    monkeypatch.setattr(G, "_audit", lambda *a: 0.5)
    monkeypatch.setattr(G, "BLOCK_ROWS", 100)
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in G.near_duplicates(df, shard=32, attempts=1, beam=1, overlap=0.0).collect()}
    assert got == all_pairs(vectors)


def test_balls_cover_all_within_their_radius():
    rng = np.random.default_rng(3)
    x = G.unit(np.concatenate([rng.normal(size=(1, 24)) + rng.normal(size=(900, 24)) * 0.08, rng.normal(size=(400, 24))]))
    leader, angle = G.cover(x, 0.18)
    assert (leader[leader] == leader).all() and (angle <= 0.18 + 1e-5).all() and (angle[leader == np.arange(len(x))] == 0).all()
    assert (np.arccos(np.clip((x * x[leader]).sum(1), -1, 1)) <= angle + 1e-7).all() and len(np.unique(leader)) < 500


def test_balls_of_several_groups_and_undecided_pairs(spark, monkeypatch):
    """Small groups, so that leaders are covered again; two clouds as far apart as the threshold, in blocks."""
    monkeypatch.setattr(G, "GROUP", 60)
    monkeypatch.setattr(G, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(8)
    a = G.unit(rng.normal(size=(1, 16)))
    side = rng.normal(size=(1, 16))
    side = G.unit(side - (side @ a.T) * a)
    x = np.concatenate([G.unit(c + rng.normal(size=(150, 16)) * 0.03) for c in (a, 0.93 * a + (1 - 0.93**2) ** 0.5 * side)])
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in G.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert got == all_pairs(rows)


def test_clusters_are_split_without_a_cap(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select("id", F.lit("r").alias("root"), F.array(*[F.randn(k + 1).cast("float") for k in range(8)]).alias("vector"))
    rows = G.stored(rows, "test-vectors")
    clusters = G._clusters(rows, 20)
    sizes = [r["n"] for r in G._deal(rows, clusters, 0.0).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 40 and sum(sizes) == 6000 and max(k.count(".") for k in clusters.centres) >= 1


def test_a_large_dense_group_takes_no_pairs(spark):
    import time

    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    x = np.float32(np.concatenate([c + rng.normal(size=(20_000, 32)) * 0.05, rng.normal(size=(500, 32))]))
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 0}))
    begun = time.perf_counter()
    out = G.near_duplicates(df).toPandas()
    assert time.perf_counter() - begun < 60
    group = out[out.vec_id < 20_000]
    assert (group.component_id == 0).all() and (group.n_links >= 19_999).all() and (out[out.vec_id >= 20_000].n_links == 0).mean() > 0.99


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0),
        (9, [1.0, 0.0], 0), (10, [2.0, 0.001], 0), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (None, [5.0, 5.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = G.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {(r.vec_id, r.n_links, r.component_id) for r in out}
    assert {(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)} < got and {(8, 3, 8), (9, 3, 8), (10, 3, 8)} < got
    assert G.near_duplicates(df.limit(0)).collect() == []
    assert G.near_duplicates(brute.with_clashes(df)).count() == len(rows)
    assert [(r.n_links, r.component_id) for r in G.near_duplicates(df.where("vec_id < 4")).orderBy("vec_id").collect()] == [(0, 1), (0, 2), (0, 3)]
