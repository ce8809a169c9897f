"""Pieces: best scores by brute force, exact decoding, the double array against a dict."""

import sentencepiece

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import brute
from rawscan.llm import sentencepiece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return C.Codec(C.read_model(f.read()))


def test_model_file_is_read(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as f:
        pieces = C.read_model(f.read())
    assert [p for p, _, _ in pieces] == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert all(abs(s - library.get_score(i)) < 1e-6 for i, (_, s, _) in enumerate(pieces))
    assert [k == 6 for _, _, k in pieces] == [library.is_byte(i) for i in range(len(pieces))]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.integers(0, 99), max_size=40), st.lists(st.binary(max_size=5), max_size=20))
def test_double_array(words, other):
    t = C.DoubleArray.build(words)
    for w in [*words, *other]:
        node = 0
        for c in w:
            step = int(t.base[node]) + c
            if t.base[node] == 0 or step >= len(t.check) or t.check[step] != node:
                node = None
                break
            node = step
        assert (-1 if node is None else int(t.value[node])) == words.get(w, -1)


def best_score(codec, word, ids):
    """Greatest score of any segmentation, and the score of the given one."""
    table = {codec.text[i].encode(): codec.score[i] for i in range(len(codec.text)) if codec.text[i]}
    text = word.encode()
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in table:
                best[j] = max(best[j], best[i] + table[text[i:j]])
            elif len(text[i:j].decode(errors="ignore")) == 1 and len(text[i:j].decode(errors="ignore").encode()) == j - i:
                best[j] = max(best[j], best[i] + C.UNKNOWN * (j - i))
    return best[-1], sum(C.UNKNOWN if i in codec.byte_ids else codec.score[i] for i in ids)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thein gaü漢😀", min_size=1, max_size=14))
def test_segmentation_is_the_best(codec, text):
    word = C.MARK + text.replace(" ", C.MARK)
    best, got = best_score(codec, word, codec.encode(text))
    assert abs(best - got) < 1e-6


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_decoding_is_exact(codec, texts):
    texts = [*texts, " two  spaces ", "▁ ▁▁x", "\n\t\u0000", "漢字 😀", ""]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == codec.encode(t)
        assert codec.decode(ids.tolist()) == t


def test_tables(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    encoded = C.encode_documents(docs, PATH)
    assert encoded.where("NOT decoded_equal").isEmpty()
    back = {r.doc_id: r.text for r in C.decode_documents(encoded, PATH).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_edges(spark):
    rows = brute.edge_rows()
    docs = spark.createDataFrame(rows, brute.DOCS)
    out = C.encode_documents(docs, PATH).collect()
    assert len(out) == len(rows) and all(r.decoded_equal for r in out)
    assert {r.n_pieces for r in out if r.doc_id in (1, 2)} == {0}
    assert C.encode_documents(docs.limit(0), PATH).collect() == []
    assert C.encode_documents(brute.with_clashes(docs), PATH).count() == len(rows)
    assert C.decode_documents(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>"), PATH).orderBy("doc_id").collect() == [(1, None), (2, "")]
