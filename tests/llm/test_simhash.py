"""SimHash: fingerprints, exact links at 3 bits, near copies by similarity."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import brute
from rawscan.llm import simhash_tables as T
from rawscan.llm import simhash_vptree as V


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÄ \t\n\x0b\x1f c", max_size=40), st.sampled_from([1, 3, 5]))
def test_fingerprint(text, n):
    assert V.fingerprint(text, n) == brute.simhash(text, n)


@pytest.mark.parametrize("seed", range(4))
def test_shards_find_every_link(seed):
    """Tree, routing and in-shard search together give the classes of all pairs within 3 bits."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    x = [*base]
    for b in base[:30]:
        for _ in range(30):
            y = int(b)
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                y ^= 1 << int(bit)
            x.append(np.uint64(y))
    x = np.unique(np.array(x, np.uint64))
    tree = V.Tree.build(x, 4, 3)
    assert tree.shards > 4
    label = np.arange(len(x))
    shard, idx, home = tree.route(x, 3)
    assert sorted(idx[home].tolist()) == list(range(len(x)))
    for s in range(tree.shards):
        mine = idx[shard == s]
        order = np.argsort(x[mine])
        mine, at_home = mine[order], home[shard == s][order]
        sub = V.link_shard(x[mine], at_home, 3)
        V.merge_labels(label, mine, mine[sub])
    want = brute.components(range(len(x)), lambda i, j: (int(x[i]) ^ int(x[j])).bit_count() <= 3)
    assert label.tolist() == [want[i] for i in range(len(x))]


def test_components_match_all_pairs(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    fps = {r.doc_id: brute.simhash(r.text) for r in docs.collect()}
    want = brute.components(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = V.simhash_components(docs).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


def _prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_near_copies_by_similarity(spark):
    """Copies of a similarity well over 0.8 go, texts well under it stay."""
    rng, rows, similar = random.Random(5), [], 0
    for g in range(40):
        w = _prose(rng, 300)
        rows.append((10 * g, " ".join(w)))
        for k, edits in enumerate((0, 2, 4, 30), 1):  # similarity 1, 0.93, 0.87, about 0.35
            v = list(w)
            for at in range(7, 300, 300 // max(edits, 1))[:edits] if edits else ():
                v[at] = f"new{rng.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(v)))
            a, b = (set(brute.shingles(" ".join(x), 5)) for x in (w, v))
            similar += len(a & b) / len(a | b) >= 0.8
    assert similar == 120
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.component_id for r in T.similar_components(docs).collect()}
    caught = sum(out[10 * g + k] == out[10 * g] == 10 * g for g in range(40) for k in (1, 2, 3))
    assert caught >= 118
    assert all(out[10 * g + 4] == 10 * g + 4 for g in range(40))
    kept = {r.doc_id for r in T.keep_one(docs).collect()}
    assert kept == {d for d, c in out.items() if d == c}


def test_tables_reach_the_recall_they_plan():
    k, tables = T.plan(1_000_000, 0.8)
    hit = (1 - T.differing(0.8)) ** k
    assert k == 18 and 1 - (1 - hit) ** tables >= T.RECALL >= 0.99


def test_a_text_between_hides_no_pair(spark, monkeypatch):
    """Three in the same bucket of every table; by SHORT bits the middle one lies between two that are near."""
    k, tables = T.plan(3, 0.8)
    rng = np.random.default_rng(11)
    sorted_by = {int(i) for _ in range(tables) for i in rng.choice(np.arange(T.SHORT, T.BITS), k, replace=False)}
    free = [i for i in range(T.SHORT, T.BITS) if i not in sorted_by]
    bits = np.zeros((3, T.BITS), np.uint8)
    bits[1, [9, *free[:300]]] = 1  # far from both
    bits[2, [*range(10), *free[300:400]]] = 1
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    rows = spark.createDataFrame([(i, fps[i].tolist()) for i in range(3)], "id bigint, fp array<bigint>")
    monkeypatch.setattr(T, "signatures", lambda *a: rows)
    assert {r.doc_id: r.component_id for r in T.similar_components(None).collect()} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("seed", range(4))
def test_every_pair_of_a_bucket_is_met_once(seed):
    rng = np.random.default_rng(seed)
    key = np.sort(np.concatenate([rng.integers(0, 50, 200), np.full(T.SMALL * 3, 60), np.full(T.SMALL, 61), np.full(T.SMALL + 1, 62)]))
    root = np.where(key == 60, rng.integers(0, 9, len(key)) ** 2 // 8, rng.integers(0, 1000, len(key)))
    got = [(min(a, b), max(a, b)) for i, j in T.cross_pairs(key, root) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(a, b) for a in range(len(key)) for b in range(a + 1, len(key)) if key[a] == key[b] and root[a] != root[b]}
    assert len(got) == len(want) and set(got) == want


def test_recall_at_the_threshold(spark):
    """All pairs of similarity 0.8 or more among 10,000 documents, by exact prefix filtering."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by_set = {}
    for r in docs.select("doc_id", "text").collect():
        by_set.setdefault(np.unique(V.shingle_hashes(r.text, 5)).tobytes(), r.doc_id)
    sets = {d: np.frombuffer(b, np.uint64) for b, d in by_set.items()}
    seen, place, pairs = Counter(), defaultdict(list), set()
    for x in sets.values():
        seen.update(x.tolist())
    for d, x in sorted(sets.items(), key=lambda t: len(t[1])):
        rare = sorted(x.tolist(), key=lambda h: (seen[h], h))
        for h in rare[: len(x) - -(-4 * len(x) // 5) + 1]:
            pairs.update((e, d) for e in place[h] if len(sets[e]) >= 0.8 * len(x))
            place[h].append(d)
    inside = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    true = [(a, b) for a, b in pairs if (n := inside(a, b)) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.component_id for r in T.similar_components(docs).collect()}
    assert len(true) > 30 and sum(got[a] == got[b] for a, b in true) >= 0.95 * len(true)


def test_tree_grows_beyond_any_fixed_depth():
    """Homes are split until small, past twelve levels; every fingerprint has one home."""
    x = np.unique(np.random.default_rng(3).integers(0, 2**64, 1 << 15, dtype=np.uint64))
    tree = V.Tree([], [], [], [], 1)
    while True:
        shard, idx, home = tree.route(x, -1)
        assert home.all() and sorted(idx.tolist()) == list(range(len(x)))
        large = np.flatnonzero(np.bincount(shard) > 16).tolist()
        if not large:
            break
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], [[k, k + 1] for k in large])
        tree.graft({k: V.Tree.build(x[idx[order[a:b]]][:4096], 6, 3) for k, (a, b) in zip(large, cuts.tolist(), strict=True)})
    depth = {tree.root: 1}
    for node in range(len(tree.point)):  # children come after their parents
        depth |= {c: depth[node] + 1 for c in (tree.left[node], tree.right[node]) if c >= 0}
    assert max(depth.values()) > 12


def test_shards_split_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(V.grown_tree, "__defaults__", (256, 2))
    rng = np.random.default_rng(5)
    x = [int(v) for v in rng.integers(0, 2**64, 1500, dtype=np.uint64)]
    x += [v ^ (1 << int(b)) ^ (1 << int(c)) for v in x[:500] for b, c in [rng.choice(64, 2, replace=False)]]
    fps = np.unique(np.array(x, np.uint64))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint")
    tree = V.grown_tree(df, 150, 3)
    shard, idx, home = tree.route(fps, 3)
    assert tree.shards > 12 and np.bincount(shard[home]).max() <= 1.5 * 150
    want = brute.components(range(len(fps)), lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 3)
    label, at = np.arange(len(fps)), {int(v): i for i, v in enumerate(fps.view(np.int64))}
    links = V.star_links(df, 3, homes=150).collect()
    V.merge_labels(label, np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert label.tolist() == [want[i] for i in range(len(fps))]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "other words are here")], "doc_id string, text string")
    for find in (V.simhash_components, T.similar_components):
        assert {(r.doc_id, r.component_id) for r in find(docs).collect()} == {("b", "a"), ("a", "a"), (None, None)}


def test_edges(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    for find in (V.simhash_components, T.similar_components):
        out = find(docs).collect()
        assert len(out) == len(rows)
        got = {(r.doc_id, r.component_id) for r in out}
        assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9)} <= got
        assert find(docs.limit(0)).collect() == []
        assert find(brute.with_clashes(docs)).count() == len(rows)
    kept = T.keep_one(brute.with_clashes(docs))
    assert kept.columns == brute.with_clashes(docs).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 4, 5, 7, 9, 10]
    assert T.keep_one(docs.limit(0)).collect() == []
