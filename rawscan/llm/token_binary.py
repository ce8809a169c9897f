"""Token ids in a compact, randomly readable form: Re-Pair grammars per shard.

Documents are dealt to shards by ranges of their id, so shard order is id order; there are as many
shards as the input has SHARD_BYTES. Each
shard is cut into blocks of whole documents; a block holds a grammar and its compressed
sequence. Its ids are first numbered anew, by those it has. Re-Pair then works in rounds: every pair at least
``min_count`` times present gets a nonterminal and is replaced from left to right, then pairs of the result are counted
again, until no pair is left that often. MIN_COUNT is where a rule pays: it takes 12 bytes
and each use saves 2. Rules with their expansion lengths and the documents' token offsets are stored,
so one document is decoded by a search in the cumulated lengths, without the rest.

The container is Parquet, written by Spark (retries and lost executors are its concern;
any file system it knows will do): a row per block with the id range, counts, the
document ids and lengths, and the payload:

  magic "RPG2", u32 ids, u32 rules, u32 symbols, u8 width (2 or 4 bytes), then little-endian:
  ids x u16, rules x (u32 left, u32 right), rules x u32 expansion length, symbols x uint(width)

Symbol k is the k-th of the block's ids, or the nonterminal k - ids.

Defined results: a null text counts as empty; texts of any length are encoded whole; document ids are integers; repeated and null ids are
kept (null first, equal ids in any order); an empty table gives an empty file set; extra columns are ignored.
A tokenizer file that splits texts otherwise than the encoder expects is refused.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, temporary, text_or_empty

_CUT = re.compile(r" (?=\S)")
#: a space before white space or the end; a wide notion of white space only costs time
_GAP_RE2 = r" ([\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: letters, which are one token of the splitter, and what may follow them: nothing, or from ASCII punctuation on
_WORD_RE2 = r"""^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>(?:[\n.,;:!?"')*$%&#-](?s:.*))?)$"""
BLOCK_TOKENS = 1 << 20
SHARD_BYTES = 4 << 20  # by the plan's statistics; Parquet files hold some twice as much text
MIN_COUNT = 7
SPELT = 32  # a reader spells out rules up to this long once
CACHE = 1_600_000  # strings of a kind, some 60 bytes each
BLOCK_SCHEMA = "shard int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


class CachedEncoder:
    """Ids of texts (uint16), through the tokenizers library, one space-led chunk at a time.

    Byte-level BPE splits a text before it merges, from left to right, and always before a
    space with a non-space behind it. So a text is the concatenation of the chunks between
    such spaces, encoded apart, each with its space. Arrow cuts a batch of texts and finds its
    distinct chunks. A chunk that is letters and then ASCII punctuation is split there too:
    its letters are one token of the splitter, so the model encodes them directly. Distinct
    letters and tails are looked up, and Arrow joins their ids again. Other chunks are encoded as one string and told apart
    by the bytes that each id stands for. Texts with special strings go to the library
    whole. The caches are Arrow arrays and only save time; the older half is forgotten when one is full.
    """

    def __init__(self, blob: bytes, special: tuple[str, ...] = ("<|endoftext|>",)):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tok, self.special = Tokenizer.from_buffer(blob), special
        self.model = self.tok.model
        self._check(blob)
        size = self.tok.get_vocab_size()
        self.n_bytes = np.array([len(self.tok.id_to_token(i)) for i in range(size)])
        # the vocabulary's letter for each byte: printable ones stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        letter = [chr(b if b in shown else next(rest)) for b in range(256)]
        self.shown = {b: c for b, c in enumerate(letter) if b > 126 and c != chr(b)}
        self.space, self.two = letter[32], [i.to_bytes(2, "little") for i in range(size)]
        self.held = {kind: (pa.array([], pa.string()), pa.array([], pa.large_binary())) for kind in ("_letters", "_joined", "_whole")}  # strings and their ids

    def _check(self, blob: bytes) -> None:
        """The shortcuts hold for one way of splitting only, and for ids of 16 bits."""
        import json

        d = json.loads(blob)
        split = d.get("pre_tokenizer") or {}
        fits = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not d.get("normalizer") and d["model"].get("type") == "BPE"
        fits = fits and not d["model"].get("dropout") and not d["model"].get("continuing_subword_prefix") and not d["model"].get("end_of_word_suffix") and not d["model"].get("ignore_merges")
        added = {t["content"] for t in d.get("added_tokens", ())}
        if not fits or added != set(self.special) or self.tok.get_vocab_size() > 65536 or d.get("truncation") or d.get("padding"):
            raise ValueError("not a byte-level BPE tokenizer that this encoder knows: it needs the plain byte-level splitter, no normalizer, no added tokens but " + ", ".join(self.special))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Chunks without their space, which end where the splitter cuts whatever follows."""
        chunks = [" " + c for c in chunks]
        data = self._whole(["".join(chunks)])[0]
        ends = np.searchsorted(np.cumsum(self.n_bytes[np.frombuffer(data, np.uint16)]), np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks]), "left") + 1
        ends = (2 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Runs of letters without their space, straight by the model."""
        text = "\n".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.shown)
        tokenize, two, space = self.model.tokenize, self.two, self.space
        return [b"".join([two[t.id] for t in tokenize(space + w)]) for w in text.split("\n")]

    def _ids(self, strings, kind: str):
        """Ids of an Arrow array of distinct strings by the method ``kind``, as an array of bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        names, ids = self.held[kind]
        at = pc.index_in(strings, value_set=names)
        missing = strings.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if len(missing):
            at[at < 0] = len(ids) + np.arange(len(missing))
            names, ids = pa.concat_arrays([names, missing]), pa.concat_arrays([ids, pa.array(getattr(self, kind)(missing.to_pylist()), pa.large_binary())])
            recent = slice(len(names) // 2 if len(names) > CACHE else 0, None)
            self.held[kind] = names[recent], ids[recent]
        return ids.take(pa.array(at))

    def _chunks(self, chunks):
        """(ids of distinct chunks, each behind a space, as an array of bytes; the index there of each chunk)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.extract_regex(chunks, _WORD_RE2)
        letters, tail = (pc.struct_field(cut, [k]).dictionary_encode() for k in (0, 1))
        words = pc.binary_join_element_wise(
            self._ids(letters.dictionary, "_letters").take(letters.indices), self._ids(tail.dictionary, "_whole").take(tail.indices), pa.scalar(b"", pa.large_binary())
        )
        where, odd = np.arange(len(chunks)), np.flatnonzero(cut.is_null().to_numpy(zero_copy_only=False))
        where[odd] = len(chunks) + np.arange(len(odd))
        return pa.concat_arrays([words, self._ids(chunks.take(pa.array(odd)), "_joined")]), where

    def encode(self, texts) -> list[bytes]:
        """``texts``: an Arrow array of strings without nulls."""
        import gc

        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        slow = pc.match_substring_regex(texts, _GAP_RE2).to_numpy(zero_copy_only=False)
        for s in self.special:
            slow = slow | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        rows = np.flatnonzero(slow)
        if len(rows):
            cut = [[t] if any(s in t for s in self.special) else _CUT.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
            heads = self._whole([c[0] for c in cut])
            parts = pa.array([p for c in cut for p in c[1:]], pa.string()).dictionary_encode()
            table, where = self._chunks(parts.dictionary)
            tails, at = table.take(pa.array(where[parts.indices.to_numpy()])).to_pylist(), 0
            for i, c, head in zip(rows.tolist(), cut, heads, strict=True):
                out[i] = head + b"".join(tails[at : at + len(c) - 1])
                at += len(c) - 1
        rows = np.flatnonzero(~slow)
        if not len(rows):
            return out
        lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        words = flat.dictionary_encode()
        table, where = self._chunks(words.dictionary)
        at = where[words.indices.to_numpy()]
        first = pa.array(starts[:-1] - starts[0])  # first chunks have no space before them
        heads = flat.take(first).dictionary_encode()
        at[first.to_numpy()] = len(table) + heads.indices.to_numpy().astype(np.int64)
        table = pa.concat_arrays([table, self._ids(heads.dictionary, "_whole")])
        _, ends, data = table.take(pa.array(at)).buffers()
        data, cuts = data.to_pybytes(), np.frombuffer(ends, np.int64, len(at) + 1)[starts - starts[0]].tolist()
        for i, a, b in zip(rows.tolist(), cuts[:-1], cuts[1:], strict=True):
            out[i] = data[a:b]
        return out


def _encoder(blob: bytes) -> CachedEncoder:
    """One encoder for each Python worker, which later tasks find with its cache warm."""
    import sys
    import types

    held = sys.modules.setdefault("__token_binary_worker__", types.ModuleType("__token_binary_worker__")).__dict__
    key = f"encoder {zlib.crc32(blob)} {len(blob)}"
    if key not in held:
        held[key] = CachedEncoder(blob)
    return held[key]


def _slot(keys: np.ndarray, second: bool = False) -> np.ndarray:
    """20 bits of a pair's hash."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2246822519 if second else 2654435761)) >> np.uint32(12)
    return (keys * np.uint64(0xC2B2AE3D27D4EB4F if second else 0x9E3779B97F4A7C15)) >> np.uint64(44)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT):
    """(sequence, rules (k, 2), expansion lengths); ids are below ``base``, nonterminals from there on.

    A round replaces all frequent pairs; after it only pairs with a symbol that is new can be frequent enough,
    for the others had too few places left. It ends when no pair has ``min_count`` places."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    sizes = np.ones(base, np.int64)
    tables = np.empty((2, 1 << 20), np.int32)
    fresh, again = 0, True  # the least new symbol; whether to look at all pairs
    while len(seq) >= 2 * min_count:
        wide = len(sizes) > 1 << 16
        if again:
            where, left, right = None, seq[:-1], seq[1:]
        else:
            new_at = seq >= fresh
            where = np.flatnonzero(new_at[:-1] | new_at[1:])
            left, right = seq[where], seq[where + 1]
        keys = (left.astype(np.uint64) << np.uint64(32)) | right if wide else (left << np.uint32(16)) | right
        ordered = np.sort(keys)
        # a value that is as it was min_count - 1 places before is frequent
        pairs = ordered[min_count - 1 :][ordered[min_count - 1 :] == ordered[: len(ordered) - min_count + 1]] if len(keys) >= min_count else keys[:0]
        if not len(pairs):
            break
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        # one place per hash and table; pairs that meet in both wait for a round of their own
        tables[0].fill(-1)
        tables[0][_slot(pairs)] = np.arange(len(pairs))
        lost = np.flatnonzero(pairs[tables[0][_slot(pairs)]] != pairs)
        tables[1][_slot(pairs[lost], True)] = lost
        waits = len(lost) and (tables[1][_slot(pairs[lost], True)] != lost).any()
        rank = tables[0][_slot(keys)]
        at = np.flatnonzero(rank >= 0)
        rank, found = rank[at], keys[at]
        wrong = np.flatnonzero(pairs[rank] != found)
        if len(wrong) and len(lost):
            tables[1][_slot(found[wrong], True)] = 0
            tables[1][_slot(pairs[lost], True)] = lost
            rank[wrong] = tables[1][_slot(found[wrong], True)]
        right_ones = pairs[rank] == found
        at, rank = at[right_ones], rank[right_ones]
        at = at if where is None else where[at]
        # of overlapping occurrences, every other one from the left of a run
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        run_start = np.maximum.accumulate(np.where(first, at, 0))
        take = (at - run_start) & 1 == 0
        at, rank = at[take], rank[take]
        # a pair that others left too few places for has no rule
        places = np.bincount(rank, minlength=len(pairs))
        used = np.flatnonzero(places >= min_count)
        if not len(used):
            break
        number = np.full(len(pairs), -1)
        number[used] = np.arange(len(used))
        rank = number[rank]
        at, rank = at[rank >= 0], rank[rank >= 0]
        half = np.uint64(32 if wide else 16)
        new = np.stack([pairs[used].astype(np.uint64) >> half, pairs[used].astype(np.uint64) & ((np.uint64(1) << half) - np.uint64(1))], 1).astype(np.int64)
        fresh, again = len(sizes), bool(waits)
        seq[at] = (fresh + rank).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        sizes = np.concatenate([sizes, sizes[new].sum(1)])
        rules.append(new)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), sizes[base:]


def expansions(rules: np.ndarray, base: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in rules.tolist():
        out.append(np.concatenate([out[s - base] if s >= base else np.array([s], np.int64) for s in (a, b)]))
    return out


def pack(ids: np.ndarray, **options) -> bytes:
    has = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else np.empty(0, np.int64)
    number = np.zeros(1 << 16, np.uint32)
    number[has] = np.arange(len(has))
    seq, rules, lengths = compress(number[ids], len(has), **options)
    width = 2 if not len(seq) or seq.max() < 65536 else 4
    return b"RPG2" + struct.pack("<IIIB", len(has), len(rules), len(seq), width) + has.astype("<u2").tobytes() + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + seq.astype(f"<u{width}").tobytes()


class Block:
    """A read payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG2":
            raise ValueError("not a token block")
        base, n_rules, n, width = struct.unpack("<IIIB", payload[4:17])
        at = 17 + 2 * base
        self.ids = np.frombuffer(payload, "<u2", base, 17)
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(payload, "<u4", n_rules, at + 8 * n_rules).astype(np.int64)
        self.seq = np.frombuffer(payload, f"<u{width}", n, at + 12 * n_rules).astype(np.int64)
        self.base = base
        self.size = np.concatenate([np.ones(base, np.int64), self.lengths])
        # ids and short rules, spelt out one after the other
        short = np.flatnonzero(self.size <= SPELT)
        self.flat = self._opened(short, 1)
        self.where = np.zeros(len(self.size), np.int64)
        self.where[short] = np.cumsum(self.size[short]) - self.size[short]

    def _opened(self, seq: np.ndarray, longest: int) -> np.ndarray:
        """``seq`` with its rules opened, a level at a time, until no expansion is over ``longest``."""
        while True:
            inner = self.size[seq] > longest
            if not inner.any():
                return seq
            width = 1 + inner
            ends = np.cumsum(width)
            out = np.empty(int(ends[-1]), np.int64)
            out[ends - width] = seq
            both = self.rules[seq[inner] - self.base]
            out[ends[inner] - 2], out[ends[inner] - 1] = both[:, 0], both[:, 1]
            seq = out

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = self._opened(seq, SPELT)
        size = self.size[seq]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[self.flat[np.arange(total) + np.repeat(self.where[seq] - (ends - size), size)]].astype(np.uint32)

    def decode(self) -> np.ndarray:
        return self._expand(self.seq)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1, expanding only the symbols that cover them."""
        ends = np.cumsum(self.size[self.seq])
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left")
        part = self._expand(self.seq[i : j + 1])
        skip = start - (int(ends[i - 1]) if i else 0)
        return part[skip : skip + n]


def _size(rows: DataFrame) -> int:
    """Bytes of ``rows`` as the plan's statistics have them (of files: as stored); where it has none, of the texts by a scan."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Token blocks of all documents under ``path``, in ascending order of id by (shard, block)."""
    with open(tokenizer, "rb") as f:
        blob = f.read()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    CachedEncoder(blob)  # refuses a file that it doesn't know before any task runs
    shards = shards or max(1, -(-_size(rows) // SHARD_BYTES))
    end = np.array([end_id], np.uint16).tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        encoder, ids, parts, held = _encoder(blob), [], [], 0

        def flush():
            nonlocal block, start, ids, parts, held
            lengths = [len(p) // 2 for p in parts]
            payload = pack(np.frombuffer(b"".join(parts), np.uint16))
            row = {"shard": shard, "block": block, "start": start, "n_tokens": held, "doc_ids": ids, "lengths": lengths, "payload": payload}
            block, start, ids, parts, held = block + 1, start + held, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        for b in slices(batches, 4096):
            for i, p in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                ids.append(i)
                parts.append(p + end)
                held += len(p) // 2 + 1
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows.repartitionByRange(shards, "id").sortWithinPartitions("id").mapInArrow(run, BLOCK_SCHEMA).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the files; start counts over all shards."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals, base, bases = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect(), 0, {}  # a row per shard
    for r in totals:
        bases[r.shard], base = base, base + r.n

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            for r in batch.to_pylist():
                data = Block(r["payload"]).decode().astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(data[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"] + bases[r["shard"]]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Random access to a few documents: only blocks that hold one are read, only its symbols expanded."""
    out: dict[int, np.ndarray] = {}
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)) for d in doc_ids])))
    for r in blocks.toLocalIterator():
        starts = np.cumsum(r.lengths) - np.array(r.lengths)
        block = Block(bytes(r.payload))
        for k, d in enumerate(r.doc_ids):
            if d in doc_ids:
                out[d] = block.read(int(starts[k]), r.lengths[k])
    return out


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = temporary(spark, "tokens")
    write(docs, path, tokenizer, **options)
    return read(spark, path)
