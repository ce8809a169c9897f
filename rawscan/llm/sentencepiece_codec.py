"""SentencePiece pieces: unigram Viterbi over a double-array trie, byte fallback, exact decoding.

Pieces come from a public model file and are never trained. Where the file's scores are
merge ranks rather than log probabilities (a BPE model), ``zipf`` scores are used: the log
probability of rank r under Zipf's law, ln(1 / (r * H)). The best segmentation has the
greatest sum of scores; a character that no piece covers costs UNKNOWN and is written as its
bytes. Ties go to the longer last piece.

White space: each " " becomes the marker, and one marker is put in front. No piece has a marker
after another character, so the best segmentation of a text is the concatenation of those
of its marker-led words: words are solved once and cached (a bounded cache that is emptied
when full). A literal marker character in the text goes by bytes, so decoding is exact.

A null text counts as empty; the empty text gives no ids.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

MARK = "▁"
UNKNOWN = -25.0  # per byte of a character that no piece covers
CACHE = 300_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def read_model(blob: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order, from the model's protobuf bytes: type 1 normal, 2 unknown, 3 control, 6 byte."""
    import struct

    def varint(b, at):
        n = shift = 0
        while True:
            n |= (b[at] & 127) << shift
            shift += 7
            at += 1
            if b[at - 1] < 128:
                return n, at

    def fields(b):
        at = 0
        while at < len(b):
            key, at = varint(b, at)
            if key & 7 == 0:
                v, at = varint(b, at)
            elif key & 7 == 1:
                v, at = b[at : at + 8], at + 8
            elif key & 7 == 2:
                n, at = varint(b, at)
                v, at = b[at : at + n], at + n
            else:
                v, at = struct.unpack("<f", b[at : at + 4])[0], at + 4
            yield key >> 3, v

    out = []
    for number, value in fields(blob):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


@dataclass
class DoubleArray:
    """base, check and value over UTF-8 bytes: child = base[node] + byte, real if check[child] = node."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id, -1 where none ends

    @staticmethod
    def build(words: dict[bytes, int]) -> DoubleArray:
        tree: dict = {}
        for w, i in words.items():
            node = tree
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 1 << 16
        base, check, value = [np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)]
        used = np.zeros(size, bool)
        used[0] = True
        queue, low, hint = [(0, tree)], 256, 256
        for node, kids in queue:  # grows while it is read
            value[node] = kids.get(-1, -1)
            codes = np.array(sorted(c for c in kids if c >= 0), np.int64)
            if not len(codes):
                continue
            while used[low]:
                low += 1
            start = low if len(codes) == 1 else hint
            while True:
                if start + 1024 > len(used):
                    more = len(used)
                    base, check, value = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(value, np.full(more, -1, np.int32))
                    used = np.append(used, np.zeros(more, bool))
                b = start + np.arange(64) - codes[0]  # places for the first child
                free = ~used[b[:, None] + codes].any(1)
                if free.any():
                    at = int(b[np.argmax(free)])
                    break
                start += 64
            if len(codes) > 1:
                hint = max(hint, start)
            base[node] = at
            used[at + codes] = True
            check[at + codes] = node
            queue += [(at + int(c), kids[int(c)]) for c in codes]
        return DoubleArray(base, check, value)


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], trie: DoubleArray | None = None, scores: str = "zipf"):
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1]
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece holds a marker after another character")
        words = {p.encode(): i for i, p, _ in normal}
        self.trie = trie or DoubleArray.build(words)
        self.score = [0.0] * len(pieces)
        if scores == "zipf":
            ranked = sorted(normal, key=lambda x: (-x[2], x[0]))
            harmonic = sum(1.0 / r for r in range(1, len(ranked) + 1))
            for r, (i, _, _) in enumerate(ranked, 1):
                self.score[i] = -float(np.log(r * harmonic))
        else:
            for i, _, s in normal:
                self.score[i] = s
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces")
        self.text = [p if kind == 1 else "" for p, _, kind in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.width = np.uint16 if len(pieces) <= 65536 else np.uint32
        self.cache: dict[str, bytes] = {}  # word without its marker -> its ids
        self.byte_ids = frozenset(self.byte_of)
        self.is_byte = np.array([i in self.byte_of for i in range(len(pieces))])

    def viterbi(self, word: bytes) -> list[int]:
        """Ids of the best segmentation of one marker-led word."""
        base, check, value, score, n = self.trie.base, self.trie.check, self.trie.value, self.score, len(word)
        best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        for i in range(n):
            if word[i] & 0xC0 == 0x80:
                continue
            here, node, j = best[i], 0, i
            width = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
            while j < n:
                step = base[node] + word[j]
                if base[node] == 0 or step >= len(check) or check[step] != node:
                    break
                node, j = step, j + 1
                v = value[node]
                if v >= 0 and here + score[v] > best[j]:
                    best[j], back[j] = here + score[v], (i, v)
            j = min(i + width, n)
            if here + UNKNOWN * (j - i) > best[j]:
                best[j], back[j] = here + UNKNOWN * (j - i), (i, None)
        out, j = [], n
        while j:
            i, v = back[j]
            out += [v] if v is not None else [self.bytes[b] for b in reversed(word[i:j])]
            j = i
        return out[::-1]

    def viterbi_all(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words at once: one array step per start and depth, over all words still in the trie."""
        pad = np.zeros(256, np.int32)
        base, check, value = np.append(self.trie.base, pad), np.append(self.trie.check, pad - 1), np.append(self.trie.value, pad - 1)
        score, size = np.array(self.score), np.array([len(w) for w in words])
        n = int(size.max())
        codes = np.zeros((len(words), n + 5), np.uint8)
        codes[np.arange(n + 5) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), n + 5), -1e300)
        best[:, 0] = 0
        back, ids = np.zeros((len(words), n + 5), np.int32), np.full((len(words), n + 5), -1, np.int32)
        for i in range(n):
            rows = np.flatnonzero((size > i) & ((codes[:, i] & 0xC0) != 0x80))
            lead = codes[rows, i]
            j = np.minimum(i + 1 + (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0), size[rows])
            byte_path = best[rows, i] + UNKNOWN * (j - i)
            node, here, at, live = np.zeros(len(rows), np.int64), best[rows, i], i, rows
            while len(live):
                step = base[node] + codes[live, at].astype(np.int64)
                ok = (base[node] > 0) & (check[step] == node) & (size[live] > at)
                node, here, live, at = step[ok], here[ok], live[ok], at + 1
                v = value[node]
                better = (v >= 0) & (here + score[v] > best[live, at])
                to = live[better]
                best[to, at], back[to, at], ids[to, at] = (here + score[v])[better], i, v[better]
            better = byte_path > best[rows, j]
            to, j = rows[better], j[better]
            best[to, j], back[to, j], ids[to, j] = byte_path[better], i, -1
        back, ids, out = back.tolist(), ids.tolist(), []
        for w, b, v in zip(words, back, ids, strict=True):
            found, j = [], len(w)
            while j:
                i = b[j]
                found += [v[j]] if v[j] >= 0 else [self.bytes[c] for c in reversed(w[i:j])]
                j = i
            out.append(found[::-1])
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, parts, missing = self.cache, [], {}
        for t in texts:
            words = t.split(" ") if t and MARK not in t else None
            if words and "" in words:
                words = None
            parts.append(words)
            if words:
                missing.update(dict.fromkeys([w for w in words if w not in cache]))
        by_size = sorted(missing, key=len)
        for k in range(0, len(by_size), 4096):
            group = by_size[k : k + 4096]
            solved = self.viterbi_all([(MARK + w).encode("utf-8", "surrogatepass") for w in group]) if len(group[-1]) <= 256 else [self.viterbi((MARK + w).encode("utf-8", "surrogatepass")) for w in group]
            cache.update(zip(group, [np.array(i, self.width).tobytes() for i in solved], strict=True))
        return [np.frombuffer(b"".join([cache[w] for w in p]), self.width) if p else np.array(self.encode(t), self.width) for t, p in zip(texts, parts, strict=True)]

    def encode(self, text: str) -> list[int]:
        """One text, word by word; literal markers go by bytes, which end a word."""
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += [self.bytes[b] for b in MARK.encode()]
            for w in _WORDS.findall((MARK if k == 0 else "") + part.replace(" ", MARK)):
                out += self.viterbi(w.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.byte_ids.isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids)).replace(MARK, " ")[1:]
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_ids else self.text[i].replace(MARK, " ").encode() for i in ids)
        return out.decode("utf-8", "surrogatepass")[1:]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, n_bytes, ids_crc32, decoded_equal) per row; the model file is read on the driver."""
    with open(model, "rb") as f:
        pieces = read_model(f.read())
    trie = Codec(pieces, None, scores).trie  # a few MB, by the size of the vocabulary
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        codec = Codec(pieces, trie, scores)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            arrays = codec.encode_all(texts)
            size = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(arrays).astype(np.int32))),
                    pa.array(np.diff(size).astype(np.int64)),
                    pa.array([int(codec.is_byte[a].sum()) for a in arrays], pa.int64()),
                    pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64()),
                    pa.array([codec.decode(a.tolist()) == t for a, t in zip(arrays, texts, strict=True)]),
                ],
                ["doc_id", "ids", "n_pieces", "n_bytes", "ids_crc32", "decoded_equal"],
            )

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, decoded_equal boolean")


def decode_documents(encoded: DataFrame, model: str, scores: str = "zipf") -> DataFrame:
    """(doc_id, text) from doc_id and ids; null ids give a null text."""
    with open(model, "rb") as f:
        pieces = read_model(f.read())
    trie = Codec(pieces, None, scores).trie

    def run(batches):
        import pyarrow as pa

        codec = Codec(pieces, trie, scores)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else codec.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")


def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
