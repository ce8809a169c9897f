"""SimHash near-duplicates found exactly through a vantage-point tree over Hamming space.

A tree of (vantage point, radius) nodes deals the distinct fingerprints to shards by Hamming
distance. It grows by size, to any depth: a shard at home to too many is split again, by vantage points
from a bounded sample of its own, until none is left that a vantage point can split; a row per tree node
reaches the driver. A fingerprint lives in
one leaf and also visits every leaf whose side of a boundary lies within the search
radius, by the triangle inequality; so each close pair meets in a shard. Within a shard
the same pruning goes on until blocks are small, then XOR and popcount decide. A shard
returns a star per class it found, not its pairs, so output stays linear in dense groups.

Cost: in uniform Hamming space a boundary band of +-3 bits holds about half of all
fingerprints, so each level multiplies visits by about 1.5 while it halves the homes: n
fingerprints make about (n / shard) ** 0.6 visits each. Shards hold 9 bytes a visit in memory.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and
link like any other; texts of any length count with all their words; repeated rows each give a row; ids keep their
type, ties go to the least; a null id gives a row and is never
chosen as component id unless the class has no other (then null); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, merge_labels, slices, stored, text_or_empty

SAMPLE = 16384  # distinct fingerprints of a shard that its split is chosen by
LEVELS = 8  # tree levels that are grown from one sample
HOMES = 65536  # wanted fingerprints at home in a shard
SHARDS = 48  # wanted shards at least, for parallelism, where there are rows enough
PAIRS_AT_ONCE = 1 << 21

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included (of the whole sequence, if shorter); none without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)] if parts else [], np.uint64)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=at[1:])
    return np.array([digest(joined[a:b], seed) for a, b in zip(at[:-words].tolist(), (at[words:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of all shingles' hashes; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()  # bit 8 * byte + i, little-endian
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp bigint) per row; ``fp`` holds the unsigned fingerprint's bits."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            fps = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


@dataclass
class Tree:
    """Arrays over nodes; child < 0 is shard -child - 1; a shard that was split again is empty."""

    point: list
    radius: list
    left: list
    right: list
    shards: int
    root: int = -1

    @staticmethod
    def build(sample: np.ndarray, depth: int, band: int, seed: int = 7) -> Tree:
        """From a sample, with shards of eight of it at least."""
        rng, t = np.random.default_rng(seed), Tree([], [], [], [], 0)

        def grow(x: np.ndarray, left: int) -> int:
            best = _split(x, band, rng) if left and len(x) >= 8 else None
            if best is None:
                t.shards += 1
                return -t.shards
            me, (point, radius) = len(t.point), best
            t.point.append(point)
            t.radius.append(radius)
            t.left.append(0)
            t.right.append(0)
            near = np.bitwise_count(x ^ point) <= radius
            t.left[me] = grow(x[near], left - 1)
            t.right[me] = grow(x[~near], left - 1)
            return me

        t.root = grow(sample, depth)
        return t

    def graft(self, trees: dict[int, Tree]) -> None:
        """Puts each tree in the place of its shard; their shards are numbered after the own ones."""
        new, points, radii, left, right = {}, [], [], [], []
        for shard, t in trees.items():
            nodes, shards = len(self.point) + len(points), self.shards
            moved = lambda c, nodes=nodes, shards=shards: c + nodes if c >= 0 else c - shards
            new[-shard - 1] = moved(t.root)
            points += t.point
            radii += t.radius
            left += [moved(c) for c in t.left]
            right += [moved(c) for c in t.right]
            self.shards += t.shards
        self.point, self.radius, self.root = self.point + points, self.radius + radii, new.get(self.root, self.root)
        self.left, self.right = [new.get(c, c) for c in self.left] + left, [new.get(c, c) for c in self.right] + right

    def route(self, x: np.ndarray, band: int):
        """(shard, index into x, at home) arrays; with a band of -1, of homes only."""
        out = []

        def go(node: int, idx: np.ndarray, home: np.ndarray) -> None:
            if not len(idx):
                return
            if node < 0:
                out.append((np.full(len(idx), -node - 1, np.int32), idx, home))
                return
            d = np.bitwise_count(x[idx] ^ self.point[node]).astype(np.int16)
            r = self.radius[node]
            near, far = d <= r + max(band, 0), d > r - max(band, 0)
            go(self.left[node], idx[near], home[near] & (d[near] <= r))
            go(self.right[node], idx[far], home[far] & (d[far] > r))

        go(self.root, np.arange(len(x)), np.ones(len(x), bool))
        if not out:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _split(x: np.ndarray, band: int, rng, tries: int = 8):
    """The vantage point and radius with the fewest fingerprints within the band of the boundary."""
    best = None
    for point in rng.choice(x, min(tries, len(x)), replace=False):
        d = np.bitwise_count(x ^ point).astype(np.int16)
        for q in (0.35, 0.5, 0.65):
            r = int(np.quantile(d, q, method="lower"))
            share = (d <= r).mean()
            if not 0.2 <= share <= 0.8:
                continue
            cost = (np.abs(d - r) <= band).mean() + abs(share - 0.5) / 2
            if best is None or cost < best[0]:
                best = (cost, point, r)
    return best and best[1:]


def link_shard(x: np.ndarray, home: np.ndarray, band: int) -> np.ndarray:
    """Labels (least index of the class) over the sorted distinct x, by links of homes with anything in the shard."""
    label, rng = np.arange(len(x)), np.random.default_rng(1)

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        step = max(1, PAIRS_AT_ONCE // max(1, len(q)))
        for i in range(0, len(h), step):
            part = h[i : i + step]
            near = np.bitwise_count(x[part][:, None] ^ x[q][None, :]) <= band
            a, b = np.nonzero(near)
            if len(a) > len(part):  # each finds itself
                new = label[part[a]] != label[q[b]]
                merge_labels(label, part[a[new]], q[b[new]])

    def go(h: np.ndarray, q: np.ndarray, depth: int) -> None:
        if not len(h) or len(q) < 2:
            return
        best = _split(x[h[:: max(1, len(h) // 512)]], band, rng, 3) if len(h) > 128 and depth < 24 else None
        if best is None:
            return compare(h, q)
        point, r = best
        dh, dq = np.bitwise_count(x[h] ^ point).astype(np.int16), np.bitwise_count(x[q] ^ point).astype(np.int16)
        near, far = dq <= r + band, dq > r - band
        if near.mean() + far.mean() > 1.9:  # no pruning to be had here
            return compare(h, q)
        go(h[dh <= r], q[near], depth + 1)
        go(h[dh > r], q[far], depth + 1)

    go(np.flatnonzero(home), np.arange(len(x)), 0)
    return label


def grown_tree(distinct: DataFrame, homes: float, band: int, sample: int = SAMPLE, levels: int = LEVELS) -> Tree:
    """A tree over ``fp`` whose shards are at home to ``homes`` fingerprints or not much more, unless no vantage point splits them."""
    tree, settled = Tree([], [], [], [], 1), set()
    while True:

        def at_home(batches):
            import pyarrow as pa

            for b in batches:
                shard, idx, _ = tree.route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).take(pa.array(idx))], ["shard", "fp"])

        dealt = distinct.select("fp").mapInArrow(at_home, "shard int, fp bigint")
        large = {r.shard: r.n for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * homes).collect() if r.shard not in settled}
        if not large:
            return tree

        def thinned(batches):
            import pyarrow as pa

            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                shard, idx, _ = tree.route(x, -1)
                every = np.array([math.ceil(large[k] / sample) if k in large else 0 for k in range(tree.shards)], np.uint64)[shard]
                mix = x[idx] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                keep = (every > 0) & (mix % np.maximum(every, 1) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(shard[keep]), b.column(0).take(pa.array(idx[keep]))], ["shard", "fp"])

        def split(table):
            import pyarrow as pa

            shard = table.column("shard")[0].as_py()
            depth = min(levels, max(1, math.ceil(math.log2(large[shard] / homes))))
            t = Tree.build(np.sort(table.column("fp").to_numpy()).view(np.uint64), depth, band)
            point = np.array(t.point, np.uint64).view(np.int64)
            row = {"shard": shard, "point": point.tolist(), "radius": t.radius, "left": t.left, "right": t.right, "shards": t.shards, "root": t.root}
            return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("point", "radius", "left", "right")], ("shards", pa.int64()), ("root", pa.int64())]))

        shape = "shard int, point array<bigint>, radius array<bigint>, left array<bigint>, right array<bigint>, shards bigint, root bigint"
        found = distinct.select("fp").mapInArrow(thinned, "shard int, fp bigint").groupBy("shard").applyInArrow(split, shape).collect()
        grafts = {r.shard: r for r in found if r.shards > 1}
        settled |= large.keys() - grafts.keys()
        tree.graft({k: Tree(list(np.array(r.point, np.int64).view(np.uint64)), list(r.radius), list(r.left), list(r.right), r.shards, r.root) for k, r in sorted(grafts.items())})


def star_links(distinct: DataFrame, radius: int = 3, homes: float | None = None) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` whose classes equal those of all pairs within ``radius``."""
    tree = grown_tree(distinct, homes or max(1024, min(HOMES, distinct.count() / SHARDS)), radius)

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            shard, idx, home = tree.route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).take(pa.array(idx)), pa.array(home)], ["shard", "fp", "home"])

    def link(table):
        import pyarrow as pa

        x, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        order = np.argsort(x)
        x, home = x[order], home[order]
        label = link_shard(x, home, radius)
        linked = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"a": x[label[linked]].view(np.int64), "b": x[linked].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp bigint, home boolean").groupBy("shard").applyInArrow(link, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    fps = stored(fingerprints(docs, id_col, text_col, words, seed), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(star_links(distinct, radius), "simhash").select(F.col("node").alias("fp"), "root")
    # stored, so that adaptive execution can split the joins with a root or a fingerprint that many have
    classes = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-classes")
    least = stored(classes.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    component = stored(classes.join(least, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(component, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")
