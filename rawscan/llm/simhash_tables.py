"""SimHash near-duplicates by shingle similarity: the vantage-point tree's links, then those at distances at which triangle bounds prune nothing.

With a ``radius``, 64-bit fingerprints link at so many bits or fewer, all of them, through the tree of ``simhash_vptree``;
what follows only adds links of texts that are less alike.

Texts of Jaccard similarity s on their shingles differ in about acos(2s / (1 + s)) / pi of all
SimHash bits: 15 % at 0.8, some 10 of 64. In uniform Hamming space a vantage-point tree with that
radius visits every leaf. So here fingerprints have
``BITS`` bits, each table puts them in buckets by
a few of these (more as the rows grow, so that a bucket holds some four texts that are not alike), and all pairs of a bucket are
compared: first by 64 other bits, then by all. Tables are as many as bring together ``RECALL`` of
the pairs at the threshold itself; more similar pairs and groups are found more surely.

Two passes after the tree: neighbours in the buckets of the first tables join most of each group, then every pair
of different classes in a bucket of any table is compared. Pairs of one class need no comparison,
and a bucket returns a star per class it joined, so what is emitted stays linear however large a
group is. A bucket is compared by one task, in blocks; its rows are held in memory, those of a
class that has no near neighbour outside it as 32 bytes each.

Defined results: as in ``simhash_vptree``; a null text counts as empty, and all texts
without words are one group; texts of fewer words than a shingle count as one shingle; texts of any length count
with all their words; an empty table gives an empty result; extra columns are kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, merge_labels, placed, slices, stored, text_or_empty, unused
from .simhash_vptree import majority, shingle_hashes, star_links

BITS = 1024
SHORT = 64  # the first bits, which no table sorts by
RECALL = 0.999
FIRST = 8  # tables of the first pass
SMALL = 64  # rows of a bucket that are paired together with those of other buckets
PAIRS_AT_ONCE = 1 << 20
STEP = 4096  # shingles at once
_PLACES = (np.arange(BITS // 8) * 256).astype(np.int64)
_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS majority bits as uint64 over the distinct shingles; each one's hash is mixed to BITS bits."""
    h, n = np.unique(hashes), 0
    salt = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(BITS // 8 * 256)
    for at in range(0, len(h), STEP):
        z = (h[at : at + STEP, None] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        n += len(z)
        counts += np.bincount((z.view(np.uint8).reshape(len(z), -1) + _PLACES).ravel(), minlength=len(counts))
    ones = counts.reshape(-1, 256) @ _OF_BYTE
    return np.packbits(ones.ravel() * 2 > n, bitorder="little").view("<u8")


def differing(similarity: float) -> float:
    """Share of bits that differ between texts of this similarity, if equally long; no more if not."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit(bits: int, similarity: float, errors: float) -> int:
    """Bits that may differ: as many as expected and some standard errors."""
    p = differing(similarity)
    return math.floor(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def plan(nodes: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits that a table sorts by, number of tables)."""
    k = max(8, math.ceil(math.log2(nodes + 1)) - 2)
    return k, max(FIRST + 1, math.ceil(math.log(1 - recall) / math.log1p(-((1 - differing(similarity)) ** k))))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, narrow: bool = False) -> DataFrame:
    """(id, fp array<bigint>) per row; with ``narrow``, also the 64 bits that the tree takes, as bigint."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            hashes = [shingle_hashes(t, words, seed) for t in b.column(1).to_pylist()]
            fps = np.array([wide_fingerprint(h) for h in hashes], np.uint64).reshape(-1, BITS // 64)
            at = np.arange(len(fps) + 1, dtype=np.int32) * (BITS // 64)
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(fps.view(np.int64).ravel()))]
            if narrow:
                columns.append(pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "narrow"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp array<bigint>{', narrow bigint' if narrow else ''}")


def _by_tree(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, joined): the least node of each node's class by the links of all fingerprints ``narrow`` within ``radius``."""
    distinct = stored(nodes.select(F.col("narrow").alias("fp")).distinct(), "simhash-narrow")
    trees = connected_components(star_links(distinct, radius), "simhash-tree").select(F.col("node").alias("narrow"), F.col("root").alias("tree"))
    # stored, so that adaptive execution can split the join with a class that many are of
    classes = stored(nodes.select("node", "narrow").join(trees, "narrow", "left").select("node", F.coalesce("tree", "narrow").alias("tree")), "simhash-trees")
    least = stored(classes.groupBy("tree").agg(F.min("node").alias("joined")), "simhash-tree-least")
    return classes.join(least, "tree").select("node", "joined")


def _keyed(nodes: DataFrame, tables: int, k: int) -> DataFrame:
    """(key, short, node, root): a row per node and table; the key is the table and the node's bits there."""
    rng = np.random.default_rng(11)
    places = np.array([rng.choice(np.arange(SHORT, BITS), k, replace=False) for _ in range(tables)])
    value = (np.int64(1) << np.arange(k, dtype=np.int64)).astype(np.int64)
    table = (np.arange(tables, dtype=np.int64) << k)[None, :]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 512):
            fps = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
            keys = sum(bits[:, places[:, i]] * value[i] for i in range(k)) | table
            n = keys.shape[1]
            columns = [keys.ravel(), np.repeat(fps[:, 0], n), *[np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "short", "node", "root"])

    return nodes.select("node", "root", "fp").mapInArrow(run, "key bigint, short bigint, node bigint, root bigint")


def _neighbours(nodes: DataFrame, tables: int, k: int, similarity: float) -> DataFrame:
    """(a, b): nodes of different roots that are neighbours in a bucket and near by SHORT bits."""
    before = F.lag(F.struct("node", "root", "short")).over(Window.partitionBy("key").orderBy("short", "node"))
    pairs = _keyed(nodes, tables, k).withColumn("before", before).where((F.col("before.root") != F.col("root")) & (F.bit_count(F.col("before.short").bitwiseXOR(F.col("short"))) <= limit(SHORT, similarity, 3)))
    return pairs.select(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b")).distinct()


def whole_buckets(batches):
    """Batches sorted by their first column, as tables that hold all rows of each of its values."""
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        elif held and held[-1].column(0)[0].as_py() != key[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def cross_pairs(key: np.ndarray, root: np.ndarray):
    """Yields index arrays (i, j), a block at a time: each pair of one key and different roots once; keys are sorted."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    i, d = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size)), 1
    while len(i):
        i = i[i + d < n]
        i = i[key[i] == key[i + d]]
        apart = i[root[i] != root[i + d]]
        if len(apart):
            yield apart, apart + d
        d += 1
    for at, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        _, which, count = np.unique(root[at : at + m], return_inverse=True, return_counts=True)
        if len(count) < 2:
            continue
        # small classes first: the largest is never compared with itself
        order = at + np.lexsort((which, count[which]))
        last = np.flatnonzero(np.r_[root[order[1:]] != root[order[:-1]], True]) + 1
        ends = np.repeat(last, np.diff(np.r_[0, last]))  # where the next class begins
        step = max(1, PAIRS_AT_ONCE // m)
        for lo in range(0, m, step):
            hi = min(lo + step, m)
            first = int(ends[lo])
            if first >= m:
                break
            a, b = np.nonzero(np.arange(first, m)[None, :] >= ends[lo:hi, None])
            yield order[lo + a], order[first + b]


def _met(nodes: DataFrame, tables: int, k: int, similarity: float) -> DataFrame:
    """(key, node, root) of all nodes that share a bucket with one of another root that is near by SHORT bits."""
    most = limit(SHORT, similarity, 3)

    def run(batches):
        import pyarrow as pa

        for t in whole_buckets(batches):
            key, short, node, root = (t.column(c).to_numpy() for c in range(4))
            hit = np.zeros(len(key), bool)
            for i, j in cross_pairs(key, root):
                near = np.bitwise_count((short[i] ^ short[j]).view(np.uint64)) <= most
                hit[i[near]] = True
                hit[j[near]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (key, node, root)], ["key", "node", "root"])

    return _keyed(nodes, tables, k).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, node bigint, root bigint")


def _stars(nodes: DataFrame, tables: int, k: int, similarity: float, most: int) -> DataFrame:
    """(a, b): roots whose classes are those of all pairs that share a bucket, are near by SHORT bits and differ in ``most`` bits at the most."""
    short = limit(SHORT, similarity, 3)

    def run(batches):
        import pyarrow as pa

        for t in whole_buckets(batches):
            key, root = t.column(0).to_numpy(), t.column(1).to_numpy()
            fps = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(key), -1)
            names, which = np.unique(root, return_inverse=True)
            label = np.arange(len(names))
            for i, j in cross_pairs(key, root):
                new = label[which[i]] != label[which[j]]
                i, j = i[new], j[new]
                near = np.bitwise_count(fps[i, 0] ^ fps[j, 0]) <= short
                i, j = i[near], j[near]
                for at in range(0, len(i), 1 << 15):
                    a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    near = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= most
                    merge_labels(label, which[a[near]], which[b[near]])
            joined = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[label[joined]]), pa.array(names[joined])], ["a", "b"])

    met = stored(_met(nodes, tables, k, similarity), "simhash-met")
    rows = met.join(nodes.select("node", "fp"), "node").select("key", "root", "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(a, b): the roots of the pairs that differ in ``most`` bits at the most."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return pairs.join(one, "a").join(two, "b").where(apart <= most).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42, radius: int | None = None) -> DataFrame:
    """(doc_id, component_id): one row per row of ``docs``; links are 64-bit fingerprints within ``radius``, if given, and texts of an estimated similarity of at least ``similarity``."""
    rows = stored(signatures(docs, id_col, text_col, words, seed, radius is not None), "simhash-wide")
    spark, prints = rows.sparkSession, rows.columns[1:]
    nodes, path = placed(rows.groupBy(*prints).agg(F.min("id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "least", *prints), "simhash-nodes")
    if radius is None:
        nodes = nodes.withColumn("root", F.col("node"))
    else:
        nodes, new = placed(nodes.join(_by_tree(nodes, radius), "node").select("node", "least", *prints, F.col("joined").alias("root")), "simhash-nodes")
        discard(spark, path)
        path = new
    k, tables = plan(nodes.count(), similarity)
    most = limit(BITS, similarity, 2)
    for whole in (False, True):
        links = _stars(nodes, tables, k, similarity, most) if whole else _verified(_neighbours(nodes, FIRST, k, similarity), nodes, most)
        roots = connected_components(links, "simhash-similar").select(F.col("node").alias("root"), F.col("root").alias("joined"))
        nodes, new = placed(nodes.join(roots, "root", "left").select("node", "least", *prints, F.coalesce("joined", "root").alias("root")), "simhash-nodes")
        discard(spark, path)
        path = new
    least = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = stored(nodes.join(least, "root").select(*prints, "component_id"), "simhash-classes")
    return rows.join(classes, prints).select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The row with the least id of each group, with all its columns; of rows that repeat that id, one. Rows with a null id stay.

    Only the ids that go, or that are repeated, are joined to the documents: they are few, so texts seldom move."""
    members = similar_components(docs, id_col, **options).where("doc_id IS NOT NULL")
    odd = members.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"), F.count("*").alias("rows")).where("n = 0 OR rows > 1")
    odd = stored(odd, "simhash-odd")
    mark = unused(docs, "__odd")
    on = F.col(id_col) == F.col(mark)
    rows = docs.join(odd.where("n = 0").select(F.col("doc_id").alias(mark)), on, "left_anti")
    repeated = odd.where("n > 0").select(F.col("doc_id").alias(mark))
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, on, "left_anti").unionAll(rows.join(repeated, on, "left_semi").dropDuplicates([id_col]))
