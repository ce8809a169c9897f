"""Benchmark items found within their edit budget, against full dynamic programming."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from . import brute
from rawscan.llm import decontaminate as D


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30), st.integers(0, 6))
def test_myers(pattern, text, limit):
    assert D.myers(pattern, text, limit) == min(brute.edit_in(pattern, text), limit + 1)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_no_match_is_missed(data):
    """Small alphabet, so that pieces hit in many places and windows overlap."""
    letters = st.text(alphabet="ab ", min_size=1, max_size=24)
    items = data.draw(st.lists(letters, max_size=4))
    text = data.draw(st.text(alphabet="ab ", max_size=60))
    m = D.Matcher(list(enumerate(items)), rate=0.2, short=4)
    norm, want = D.normalise(text), {}
    for i, t in enumerate(items):
        p = D.normalise(t)
        if 0 < len(p) < 4:
            if b" " + p + b" " in b" " + norm + b" ":
                want[i] = 0
        elif p and (e := brute.edit_in(p, norm)) <= int(0.2 * len(p)):
            want[i] = e
    assert dict(m.match(text)) == want


def test_short_items_match_within_a_text_at_word_bounds():
    m = D.Matcher([(1, "What is the capital of Peru?"), (2, "yes"), (3, "a b")])
    assert m.match("Q: what is the capital of peru - Lima") == [(1, 0)]
    assert m.match("what is the capital of perus eyes yesterday") == [] and m.match("Yes!") == [(2, 0)] and m.match("so: A, b.") == [(3, 0)]


def test_many_equal_pieces_in_a_long_text():
    item = "ab " * 40
    m = D.Matcher([(1, item), (2, "ab cd " * 12)])
    assert m.match("ab " * 200_000) == [(1, 0)]


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("d1", "tell me: what is the capital of peru?"), (None, "what is the capital of peru"), ("d2", "no")], "doc_id string, text string")
    bench = spark.createDataFrame([("i1", "What is the capital of Peru?"), ("i2", "x" * 50)], "item_id string, text string")
    for size in (1 << 20, 1):
        assert sorted(D.contaminated(docs, bench, block_bytes=size).collect(), key=repr) == sorted([("d1", "i1", 0), (None, "i1", 0)], key=repr)
        assert [r.doc_id for r in D.remove_contaminated(docs, bench, block_bytes=size).collect()] == ["d2"]


def test_cut():
    for n in range(1, 60):
        for k in range(1, min(n, 9) + 1):
            parts = D.cut(bytes(range(n)), k)
            assert b"".join(p for _, p in parts) == bytes(range(n)) and all(bytes(range(n))[a : a + len(p)] == p for a, p in parts) and len(parts) == k


def test_table_and_planted_items(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{brute.SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(3)
    planted = []
    for i, t in items.items():
        noisy = list(t.upper())
        for at in rng.sample(range(len(noisy)), int(0.03 * len(noisy))):
            noisy[at] = rng.choice("qxz")
        planted.append((10_000 + i, f"before {''.join(noisy)}, after"))
    both = docs.unionAll(spark.createDataFrame(planted, "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(both, bench).collect()}
    assert {(10_000 + i, i) for i in items} <= set(got)
    texts = {r.doc_id: D.normalise(r.text) for r in docs.collect()}
    exact = {(d, i) for d, n in texts.items() for i, t in items.items() if D.normalise(t) in n}
    assert exact == {k for k, e in got.items() if e == 0 and k[0] < 10_000}
    small = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(both, bench, block_bytes=1000).collect()}
    assert small == got
    left = {r.doc_id for r in D.remove_contaminated(both, bench, block_bytes=1000).collect()}
    assert left == {r.doc_id for r in both.collect()} - {d for d, _ in got}


def test_edges(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same words, HERE"), (3, "same words, HERE"), (None, "lorem ipsum dolor sit amet lorem ipsum dolor"), (5, "?!")], "item_id bigint, text string")
    got = sorted({(r.doc_id, r.item_id, r.distance) for r in D.contaminated(docs, bench).collect()}, key=repr)
    assert got == [(5, None, 0), (6, None, 0), (7, 3, 0), (8, 3, 0), (9, 3, 0)]
    more = brute.with_clashes(docs)
    for size in (1 << 20, 1):
        left = D.remove_contaminated(more, bench, block_bytes=size)
        assert left.columns == more.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, -1, 1, 2, 3, 4, 10]
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert D.contaminated(a, b).collect() == [] and D.remove_contaminated(a, b).count() == a.count()
