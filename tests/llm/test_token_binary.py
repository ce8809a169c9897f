"""Token files: ids as the library gives them, Re-Pair round trips, random access."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from . import brute
from rawscan.llm import token_binary as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return B.CachedEncoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abß 's1!,.\n\t\u00a0\u0085\x1cé漢😀\u2009ł", max_size=30), max_size=4))
def test_encoder_is_the_library(encoder, library, texts):
    texts = [*texts, "x <|endoftext|> y", "don't  stop ", "", "It's naïve: they'll-go, 're's.\nNew line'd don't", " lead", "Grüße, Äö! ñandú"]
    for t, got in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(got, np.uint16).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(2, 5))
def test_repair_round_trip(ids, min_count):
    ids = np.array(ids, np.uint16)
    block = B.Block(B.pack(ids, min_count=min_count))
    assert block.decode().tolist() == ids.tolist()
    for start in range(0, len(ids), 7):
        assert block.read(start, min(5, len(ids) - start)).tolist() == ids[start : start + 5].tolist()
    assert block.lengths.tolist() == [len(x) for x in B.expansions(block.rules, block.base)]
    # no pair is left that often, but for overlaps within a run
    left = block.seq.tolist()
    for pair in set(zip(left, left[1:], strict=False)):
        count = k = 0
        while k < len(left) - 1:
            hit = (left[k], left[k + 1]) == pair
            count, k = count + hit, k + 1 + hit
        assert count < 2 * min_count


def test_repair_goes_on_without_a_cap():
    """More rules than two bytes have room for, and expansions far over sixteen ids."""
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 50_000, (40_000, 2)).astype(np.uint16)
    ids = np.concatenate([*[pairs[rng.permutation(len(pairs))].ravel() for _ in range(8)], np.tile(np.arange(50, dtype=np.uint16), 4000)])
    block = B.Block(B.pack(ids))
    assert len(block.rules) > 30_000 and block.base + len(block.rules) > 65_536 and block.lengths.max() > 1000 and (block.decode() == ids).all()


def test_repair_compresses_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint16), 4000)
    assert len(B.pack(ids)) < len(ids.tobytes()) / 100


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="byte-level"):
        B.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_files_hold_all_documents(spark, library, tmp_path):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text")
    want, start = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = str(tmp_path / "tokens")
    B.write(docs, path, PATH, block_tokens=5000)
    got = B.read(spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    some = sorted(want)[::40]
    for d, ids in B.read_documents(spark, path, some).items():
        assert zlib.crc32(ids.astype("<u4").tobytes()) == want[d][2] and len(ids) == want[d][1]
    with pytest.raises(Exception, match="(?i)already exists"):
        B.write(docs, path, PATH)


def test_edges(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    out = B.round_trip(docs, PATH).collect()
    assert sorted(r.doc_id or -1 for r in out) == sorted(r[0] or -1 for r in rows)
    assert {(r.n_tokens, r.ids_crc32) for r in out if r.doc_id in (1, 2)} == {(1, zlib.crc32(bytes(4)))}
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    assert [r.doc_id or -1 for r in ordered] == sorted(r[0] or -1 for r in rows)
    assert B.round_trip(docs.limit(0), PATH).collect() == []
    assert B.round_trip(brute.with_clashes(docs), PATH).count() == len(rows)
