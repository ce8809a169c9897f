"""Benchmark decontamination by pigeonhole: an item within k edits leaves one of k + 1 pieces intact.

Texts and items are normalised alike (lower case; runs of ASCII white space and punctuation
become one space; UTF-8 bytes). An item of m bytes has a budget of k = floor(rate * m) edits
and is cut into k + 1 pieces; an Aho-Corasick automaton finds all exact piece hits of a block
of items in one pass over a text; each hit names a window, overlapping windows of an item
merge, and Myers' bit-parallel algorithm gives the least edit distance of the item to any
part of the window. No true match is missed, whatever the hits.

Short items, of under ``SHORT`` bytes, have a budget of no edits and match at word bounds only: a
few letters within a longer word, or a word with an edit, say nothing.

Items are a stated query set: their bytes are checked, and a set over ``block_bytes`` is
worked off in blocks of bounded size, each shipped to the tasks once, against all documents; the
hits of a block are stored before the next one is read, so the driver holds one block.

Defined results: empty or null items and texts, and those of punctuation only, match nothing; texts of any
length are searched whole; equal items match alike; repeated rows give repeated matches; repeated
item ids count as one item each; ids keep their type and null ids are carried through; an empty
table on either side gives no match; extra columns are ignored, and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty, unused

RATE = 0.06
SHORT = 32
BLOCK_BYTES = 8 << 20
_BLANK = bytes(32 if chr(i) in string.punctuation + string.whitespace + "\x1c\x1d\x1e\x1f\0" and i < 128 else i for i in range(256))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())


def cut(item: bytes, pieces: int) -> list[tuple[int, bytes]]:
    """(offset, piece) with lengths that differ by one at most."""
    size, more = divmod(len(item), pieces)
    out, at = [], 0
    for i in range(pieces):
        n = size + (i < more)
        out.append((at, item[at : at + n]))
        at += n
    return out


def myers(pattern: bytes, text: bytes, limit: int) -> int:
    """Least edit distance of the pattern to any substring of the text, or limit + 1 where it is larger."""
    m = len(pattern)
    if pattern in text:
        return 0
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, get = mask, 0, m, min(m, limit + 1), peq.get  # the empty substring is m edits away
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & mask
        pv = (mh << 1) & mask | ~(xv | ph) & mask
        mv = ph & xv
    return best


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, short: int = SHORT):
        import ahocorasick

        self.items, at = [], {}
        for item_id, text in items:
            norm = normalise(text or "")
            if not norm:
                continue
            if len(norm) < short:
                at.setdefault(b" " + norm + b" ", []).append((len(self.items), -1))
                k = 0
            else:
                k = int(rate * len(norm))
                for offset, piece in cut(norm, k + 1):
                    at.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, norm, k))
        self.automaton = None
        if at:
            self.automaton = ahocorasick.Automaton()
            for piece, where in at.items():
                self.automaton.add_word(piece.decode("latin-1"), (len(piece), where))
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[object, int]]:
        """(item id, least distance) for each item within its budget."""
        norm = normalise(text)
        if self.automaton is None or not norm:
            return []
        windows: dict[int, list] = {}
        # a space at either end, for the word bounds of short items
        for end, (n, where) in self.automaton.iter(f" {norm.decode('latin-1')} "):
            for i, offset in where:
                if offset < 0:
                    windows[i] = []
                    continue
                _, item, k = self.items[i]
                start = end - n - offset
                lo, hi = max(0, start - k), start + len(item) + k
                spans = windows.setdefault(i, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        out = []
        for i, spans in windows.items():
            item_id, item, k = self.items[i]
            best = k + 1 if spans else 0
            for lo, hi in spans:
                best = min(best, myers(item, norm[lo:hi], k))
                if not best:
                    break
            if best <= k:
                out.append((item_id, best))
        return out


def blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The items as lists of bounded size, in order of arrival; an item over the size has a block of its own."""
    held, size = [], 0
    for r in benchmark.select(item_id, item_text).toLocalIterator():
        n = len((r[1] or "").encode("utf-8", "surrogatepass"))
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def _hits(rows: DataFrame, items: list, item_type, rate: float, short: int) -> DataFrame:
    """``rows`` (id, text, ...) less the text, with (item_id, distance): a row for each match with one block."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegerType, StructType

    carried = [c for c in rows.columns if c != "text"]
    schema = StructType([rows.schema[c] for c in carried]).add("item_id", item_type).add("distance", IntegerType())

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, rate, short)
        for b in slices(batches):
            found = [(k, i, e) for k, t in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()) for i, e in matcher.match(t)]
            at = pa.array([f[0] for f in found], pa.int64())
            kept = [b.column(b.schema.get_field_index(c)).take(at) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[1] for f in found], to_arrow_type(item_type)), pa.array([f[2] for f in found], pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every pair within the budget."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return _all_hits(rows, benchmark, item_id, item_text, rate, short, block_bytes)


def _all_hits(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, rate: float, short: int, block_bytes: int) -> DataFrame:
    out = held = None
    item_type = benchmark.schema[item_id].dataType
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        if held is not None:  # there is more than one block: no plan keeps its items
            part = stored(_hits(rows, held, item_type, rate, short), "benchmark-hits")
            out = part if out is None else out.unionAll(part)
        held = items
    last = _hits(rows, held or [], item_type, rate, short)
    return last if out is None else out.unionAll(stored(last, "benchmark-hits"))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, short: int = SHORT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were: in one pass without a shuffle where the
    items are one block, else by the ids and text hashes of the hits of all blocks."""
    some = blocks(benchmark, item_id, item_text, block_bytes)
    items, more = next(some, []), next(some, None)
    if more is None:

        def run(batches):
            import pyarrow as pa

            matcher = Matcher(items, rate, short)
            for b in slices(batches):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not matcher.match(t or "") for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    its_id, its_hash = unused(docs, "__id"), unused(docs, "__hash")
    rows = docs.select(F.col(id_col).alias(its_id), F.xxhash64(text_col).alias(its_hash), text_or_empty(text_col).alias("text"))
    gone = stored(_all_hits(rows, benchmark, item_id, item_text, rate, short, block_bytes).select(its_id, its_hash).distinct(), "benchmark-gone")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.xxhash64(text_col) == F.col(its_hash)), "left_anti")


def op10_decontaminate(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
