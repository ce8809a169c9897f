"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors of a label become one node with a count. Nodes within half the threshold's angle of a
leader become a ball with it: all its members link with each other, so a dense group is a few
balls and none of its pairs is looked at. Balls are formed in groups of bounded size (by coarse
cluster and hash), then among the leaders of these, until that gains little.

Balls are dealt to shards by a tree of centroids: a cluster over twice ``shard`` balls is split again from a
sample of its own, so shards stay small at any size. A ball is at home in the nearest cluster and visits others whose
centroid is nearly as near. Each shard builds a flat proximity graph with robust pruning, from each ball's
nearest and, apart from those, from random members: where a dense group fills all nearest places, the
latter alone lead out of it. The adjacency lists of balls in several shards are united. Search
then walks, in every home shard, from the nearest medoids by best-first steps and widens through
balls within range; a query that finds more than ``MANY`` is compared with all members of its shard instead.

A pair of balls links as a whole, or not at all, where triangle bounds say so; single vectors are
verified by cosine in double precision; what is left undecided is compared member by member, in blocks of bounded size.
Vectors are shuffled a fixed number of times; links, lists and labels travel by node number.

A sample of nodes, half of them with links found, is audited against all nodes of their label: recall is the
lesser of that over links and over nodes; null where the sample has no true link. Below
``want_recall`` the overlap, the beam and the random members are doubled and it runs
again; if that does not help either, the whole label is compared in pairs of blocks of ``BLOCK_ROWS`` nodes: exact,
quadratic, and of bounded memory.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; vectors of different lengths don't link; repeated
rows each give a row and link with each other; a null id gives a row with kept false; ids are integers; ties go
to the least id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, merge_labels, stored

THRESHOLD = 0.93
SHARD = 2048
SPLIT_SAMPLE, FAN = 4096, 64  # vectors that a cluster is split by, clusters it is split into at most
GROUP = 4096  # nodes that form balls together
BLOCK_ROWS = 4096  # nodes on either side of a blocked comparison
OVERLAP = 0.2  # radians beyond the angle to the nearest centroid
DEGREE, CANDIDATES, PRUNE = 20, 48, 1.2
FAR_DEGREE, FAR_CANDIDATES = 12, 48  # members at random
BEAM = 24
SLACK = 0.03
MANY = 256
AUDIT = 64
BLOCK = 256
EPSILON = 1e-6  # radians by which angles of balls may be off


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def _pruned(x: np.ndarray, cand: np.ndarray, s: np.ndarray, degree: int) -> np.ndarray:
    """(rows, degree) of the candidates, nearest first, without those that a chosen one is nearer to; -1 pads."""
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    among = np.einsum("bid,bjd->bij", x[cand], x[cand])
    alive, pick, out = s > -9, np.arange(len(cand)), np.full((len(cand), degree), -1, np.int64)
    for d in range(degree):
        first = alive.argmax(1)
        some = alive[pick, first]
        if not some.any():
            break
        out[some, d] = cand[pick, first][some]
        alive &= PRUNE * (1 - among[pick, first]) > 1 - s
        alive[pick, first] = False
    return out


def build(x: np.ndarray, far: int = FAR_CANDIDATES, seed: int = 5) -> np.ndarray:
    """(n, DEGREE + FAR_DEGREE) neighbours by robust pruning of the nearest candidates and of ``far`` random ones; -1 pads."""
    n, rng = len(x), np.random.default_rng(seed)
    out = np.full((n, DEGREE + FAR_DEGREE), -1, np.int64)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return out
    x = x.astype(np.float32)
    for i in range(0, n, BLOCK):
        rows = np.arange(i, min(i + BLOCK, n))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -9
        cand = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        out[rows, :DEGREE] = _pruned(x, cand, np.take_along_axis(sim, cand, 1), DEGREE)
        if n - 1 > c:
            cand = rng.integers(0, n, (len(rows), far))
            out[rows, DEGREE:] = _pruned(x, cand, np.take_along_axis(sim, cand, 1), FAR_DEGREE)
    return out


class Graph:
    """Neighbours of node i: to[start[i] : start[i + 1]]."""

    def __init__(self, start: np.ndarray, to: np.ndarray):
        self.start, self.to = start, to

    @staticmethod
    def undirected(i: np.ndarray, j: np.ndarray, n: int) -> Graph:
        """All edges lead back too: in a dense group some nodes are on nobody's list."""
        edges = np.unique(np.concatenate([i * n + j, j * n + i]))
        return Graph(np.searchsorted(edges, np.arange(n + 1) * n), edges % n)

    def around(self, queries: np.ndarray, nodes: np.ndarray):
        """(query, neighbour) arrays."""
        size = self.start[nodes + 1] - self.start[nodes]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[nodes] - (ends - size), size)
        return np.repeat(queries, size), self.to[at]


def medoids(x: np.ndarray, k: int) -> np.ndarray:
    """The member nearest the mean, then those farthest from all so far."""
    first = int((x @ x.mean(0)).argmax())
    out, near = [first], x @ x[first]
    while len(out) < k:
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        out.append(far)
        near = np.maximum(near, x @ x[far])
    return np.array(out)


def search(x: np.ndarray, adjacent: Graph, queries: np.ndarray, threshold, beam: int = BEAM):
    """Yields (query, member) index arrays with cosine >= threshold (one, or one for each member as a query), a block of queries at a time, no query with itself."""
    n, f = len(x), x.astype(np.float32)
    threshold = np.broadcast_to(np.asarray(threshold, np.float64), (n,))
    starts = medoids(f, min(n, max(8, int(n**0.5))))
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        m, row = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((m, n), bool)
        sim = f[q] @ f[starts].T
        top = np.argsort(-sim, axis=1)[:, : min(8, len(starts))]
        ids, sims = starts[top], np.take_along_axis(sim, top, 1)
        sims = np.where(ids == q[:, None], -9, sims)
        # a query is a node itself: its own list is an entry too, the surest way into a dense group
        ids, sims = np.concatenate([ids, q[:, None]], 1), np.concatenate([sims, np.ones((m, 1), np.float32)], 1)
        seen[row, ids] = True
        done = sims <= -9
        at_q, at_n = np.nonzero(~done)
        pool_q, pool_n, pool_s = [at_q], [ids[at_q, at_n]], [sims[at_q, at_n]]
        while True:
            open_ = np.where(done, -9, sims)
            best = open_.argmax(1)
            live = np.flatnonzero(open_[np.arange(m), best] > -9)
            if not len(live):
                break
            done[live, best[live]] = True
            lq, near = adjacent.around(live, ids[live, best[live]])
            new = ~seen[lq, near]
            flat = np.unique(lq[new] * n + near[new])
            lq, near = flat // n, flat % n
            seen[lq, near] = True
            s = np.einsum("ij,ij->i", f[q[lq]], f[near])
            pool_q.append(lq)
            pool_n.append(near)
            pool_s.append(s)
            width = int(np.bincount(lq, minlength=1).max()) if len(lq) else 0
            if not width:
                continue
            place = np.arange(len(lq)) - np.searchsorted(lq, lq)
            more_i, more_s = np.full((m, width), -1), np.full((m, width), -9.0, np.float32)
            more_i[lq, place], more_s[lq, place] = near, s
            ids, sims = np.concatenate([ids, more_i], 1), np.concatenate([sims, more_s], 1)
            done = np.concatenate([done, more_s <= -9], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
        fq, fn, fs = np.concatenate(pool_q), np.concatenate(pool_n), np.concatenate(pool_s)
        near = fs >= threshold[q[fq]] - SLACK
        fq, fn = fq[near], fn[near]
        # in a dense part of the graph one product with all members costs less than to follow its edges
        many = np.bincount(fq, minlength=m) > MANY
        if many.any():
            yield from scan(x, q[many], threshold)
            fq, fn = fq[~many[fq]], fn[~many[fq]]
        while len(fq):  # widen: neighbours of what is in range
            for i in range(0, len(fq), 1 << 16):
                yield from _verified(x, q[fq[i : i + (1 << 16)]], fn[i : i + (1 << 16)], threshold)
            next_q, next_n = [], []
            for i in range(0, len(fq), 1 << 14):
                lq, near = adjacent.around(fq[i : i + (1 << 14)], fn[i : i + (1 << 14)])
                new = ~seen[lq, near]
                flat = np.unique(lq[new] * n + near[new])
                lq, near = flat // n, flat % n
                seen[lq, near] = True
                s = np.einsum("ij,ij->i", f[q[lq]], f[near])
                keep = s >= threshold[q[lq]] - SLACK
                next_q.append(lq[keep])
                next_n.append(near[keep])
            fq, fn = np.concatenate(next_q), np.concatenate(next_n)


def scan(x: np.ndarray, queries: np.ndarray, threshold):
    """As ``search``, by comparison with every member."""
    f = x.astype(np.float32)
    threshold = np.broadcast_to(np.asarray(threshold, np.float64), (len(x),))
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        for i in range(0, len(x), 1 << 13):
            a, b = np.nonzero(f[q] @ f[i : i + (1 << 13)].T >= threshold[q][:, None] - 1e-3)
            for k in range(0, len(a), 1 << 16):
                yield from _verified(x, q[a[k : k + (1 << 16)]], i + b[k : k + (1 << 16)], threshold)


def _verified(x, a, b, threshold):
    ok = (a != b) & (np.einsum("ij,ij->i", x[a], x[b]) >= threshold[a])
    if ok.any():
        yield a[ok], b[ok]


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(column, "chunks"):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Clusters:
    """A tree of centroids: a cluster's name is its parent's, a dot and its number; the roots are label/length."""

    def __init__(self):
        self.centres: dict[str, np.ndarray] = {}

    def assign(self, root: str, x: np.ndarray, overlap: float) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(leaf, rows of x, whether each is at home there)."""
        out = []

        def go(name: str, rows: np.ndarray, home: np.ndarray) -> None:
            c = self.centres.get(name)
            if c is None:
                out.append((name, rows, home))
                return
            angle = np.arccos(np.clip(x[rows] @ c.T, -1, 1))
            nearest, least = angle.argmin(1), angle.min(1)
            for k in range(len(c)):
                here = (nearest == k) | (angle[:, k] <= least + overlap if overlap else False)
                if here.any():
                    go(f"{name}.{k}", rows[here], home[here] & (nearest[here] == k))

        go(root, np.arange(len(x)), np.ones(len(x), bool))
        return out


def _by_root(batch):
    """(root, rows, unit vectors) for the columns root and vector, last in a batch."""
    import pyarrow as pa

    roots = np.array(batch.column(batch.num_columns - 2).to_pylist(), object)
    for root in dict.fromkeys(roots.tolist()):
        rows = np.flatnonzero(roots == root)
        yield root, rows, unit(_matrix(batch.column(batch.num_columns - 1).take(pa.array(rows))))


def _deal(rows: DataFrame, clusters: Clusters, overlap: float) -> DataFrame:
    """``rows`` (..., root, vector) less the root, with (shard, home) in front: a row for each shard it is at home in or visits."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for root, rows_, x in _by_root(b):
                for leaf, at, home in clusters.assign(root, x, overlap):
                    part = b.take(pa.array(rows_[at]))
                    kept = [part.column(i) for i in range(b.num_columns) if i != b.num_columns - 2]
                    yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(at), pa.string()), pa.array(home), *kept], names)

    kept = [f for f in rows.schema if f.name != "root"]
    names = ["shard", "home", *[f.name for f in kept]]
    return rows.mapInArrow(run, "shard string, home boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))


def _clusters(rows: DataFrame, shard: int, levels: int = 40) -> Clusters:
    """Clusters of ``rows`` (id, root, vector) of about ``shard`` rows; what reaches the driver is a row per cluster."""
    clusters, settled = Clusters(), set()
    for _ in range(levels):
        sizes = _deal(rows.select("id", "root", "vector"), clusters, 0.0).groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
        large = {r.shard: r.n for r in sizes.collect() if r.shard not in settled}
        if not large:
            break

        def sampled(batches):
            import pyarrow as pa

            for b in batches:
                mix = b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                for root, rows_, x in _by_root(b):
                    for leaf, at, _ in clusters.assign(root, x, 0.0):
                        if leaf in large:
                            at = at[mix[rows_[at]] % np.uint64(math.ceil(large[leaf] / SPLIT_SAMPLE)) == 0]
                            yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(at), pa.string()), b.column(2).take(pa.array(rows_[at]))], ["shard", "vector"])

        def split(table):  # runs within this round: the sizes are its own
            import pyarrow as pa

            name = table.column("shard")[0].as_py()
            c = centroids(unit(_matrix(table.column("vector"))), min(FAN, math.ceil(large[name] / shard)))
            c = np.unique(c, axis=0)
            return pa.table({"shard": [name] * len(c), "centre": pa.array(c.tolist(), pa.list_(pa.float64()))})

        found: dict[str, list] = {}
        for r in rows.select("id", "root", "vector").mapInArrow(sampled, "shard string, vector array<float>").groupBy("shard").applyInArrow(split, "shard string, centre array<double>").collect():
            found.setdefault(r.shard, []).append(r.centre)
        settled |= {k for k in large if len(found.get(k, ())) < 2}
        clusters.centres |= {k: np.array(sorted(v)) for k, v in found.items() if len(v) > 1}
    return clusters


def cover(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader of each row, angle to it): rows within ``radius`` of a leader join the nearest such one, in order."""
    leader, least = np.arange(len(x)), math.cos(radius)
    chosen: list[int] = []
    for at in range(0, len(x), 512):
        rows = np.arange(at, min(at + 512, len(x)))
        if chosen:
            sim = x[rows] @ x[chosen].T
            near = sim.argmax(1)
            ok = sim[np.arange(len(rows)), near] >= least
            leader[rows[ok]] = np.array(chosen)[near[ok]]
            rows = rows[~ok]
        close = x[rows] @ x[rows].T >= least
        free = np.ones(len(rows), bool)
        for i in np.flatnonzero(close.sum(1) > 1).tolist():
            if free[i]:
                leader[rows[free & close[i]]] = rows[i]
                free &= ~close[i]
        chosen += rows[leader[rows] == rows].tolist()
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, x[leader]), -1, 1)) + EPSILON
    return leader, np.where(leader == np.arange(len(x)), 0.0, angle)


def _balls(nodes: DataFrame, radius: float) -> DataFrame:
    """(node, ball, angle): each node's leader, itself where none is near, and the angle to it at most."""
    clusters = Clusters()
    rows = nodes.select(F.col("node").alias("id"), "root", "vector")
    coarse = _clusters(rows, SHARD, levels=1)
    clusters.centres = coarse.centres
    homes = stored(_deal(rows, clusters, 0.0), "vector-homes")

    def run(table):
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column("id").to_numpy())))
        ids = table.column("id").to_numpy()
        leader, angle = cover(unit(_matrix(table.column("vector"))), radius)
        return pa.table({"id": ids, "leader": ids[leader], "angle": angle})

    before, left, out = None, homes, None
    while True:
        sizes = left.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
        dealt = left.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
        found = stored(dealt.groupBy("shard", "salt").applyInArrow(run, "id bigint, leader bigint, angle double"), "vector-balls")
        if out is None:
            out = found.select(F.col("id").alias("node"), F.col("leader").alias("ball"), "angle")
        else:
            step = found.select(F.col("id").alias("ball"), "leader", F.col("angle").alias("more"))
            # a leader's own leader may be a little farther than the radius from a member: pairs of a ball need both within it
            joined = out.join(step, "ball").withColumn("sum", F.col("angle") + F.col("more"))
            out = stored(joined.select("node", F.when(F.col("sum") <= radius, F.col("leader")).otherwise(F.col("ball")).alias("ball"), F.when(F.col("sum") <= radius, F.col("sum")).otherwise(F.col("angle")).alias("angle")), "vector-balls")
        n = out.select("ball").distinct().count()
        if before is not None and n > 0.9 * before or sizes.where("salts > 1").isEmpty():
            return out
        before = n
        left = homes.join(out.select(F.col("ball").alias("id")).distinct(), "id", "left_semi").select(*homes.columns)


def _builder(far: int):
    def run(table):
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column("ball").to_numpy())))
        ball = table.column("ball").to_numpy()
        lists = [np.unique(ball[a[a >= 0]]).tolist() for a in build(unit(_matrix(table.column("vector"))), far)]
        return pa.table({"shard": table.column("shard"), "ball": ball, "near": pa.array(lists, pa.list_(pa.int64()))})

    return run


def _searcher(threshold: float, beam: int):
    """Links and classes of the balls of a shard, and pairs that only their members can decide."""
    limit = math.acos(threshold)

    def run(members, lists):
        import pyarrow as pa

        members = members.take(pa.array(np.argsort(members.column("ball").to_numpy())))
        ball, home, n, rho = (members.column(c).to_numpy() for c in ("ball", "home", "n", "rho"))
        x = unit(_matrix(members.column("vector")))
        near = lists.column("near").combine_chunks()
        i = np.searchsorted(ball, np.repeat(lists.column("ball").to_numpy(), near.value_lengths().to_numpy(zero_copy_only=False)))
        to = near.flatten().to_numpy(zero_copy_only=False)
        j = np.minimum(np.searchsorted(ball, to), len(ball) - 1)
        here = ball[j] == to
        # the one with the greater radius finds the other, at twice its radius beyond the limit
        reach = np.where(rho > 0, np.cos(np.minimum(limit + 2 * rho, math.pi)), threshold)
        label, links, odd = np.arange(len(ball)), np.zeros(len(ball), np.int64), []
        for a, b in search(x, Graph.undirected(i[here], j[here], len(ball)), np.flatnonzero(home), reach, beam):
            keep = rho[b] <= rho[a]
            a, b = a[keep], b[keep]
            one = rho[a] == 0  # both single, and verified
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", x[a], x[b]), -1, 1))
            sure = one | (angle + rho[a] + rho[b] + EPSILON <= limit)
            unsure = ~sure & (angle - rho[a] - rho[b] - EPSILON <= limit)
            np.add.at(links, a[sure], n[b[sure]])
            both = sure & (rho[b] < rho[a])  # equal radii: each finds the other
            np.add.at(links, b[both], n[a[both]])
            merge_labels(label, a[sure], b[sure])
            odd.append(np.unique(np.stack([np.minimum(a, b)[unsure], np.maximum(a, b)[unsure]]), axis=1))
        odd = np.unique(np.concatenate(odd, axis=1), axis=1) if odd else np.zeros((2, 0), np.int64)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ball))))
        none = pa.nulls(odd.shape[1], pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([ball[some], ball[odd[0]]])), "b": pa.array(np.concatenate([ball[label[some]], ball[odd[1]]])),
            "links": pa.chunked_array([pa.array(links[some]), none], pa.int64()),
        })

    return run


def _compared(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): links of node a with nodes of the other group of each pair, and b the least of its class there.

    ``members``: grp, node, vector, n; ``pairs``: one, two, names of groups of bounded size; a group may be paired with itself."""
    ends = pairs.select("one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))).alias("grp"))

    def run(table):
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column("node").to_numpy())))
        first = table.column("one")[0].as_py()
        left = np.array([g == first for g in table.column("grp").to_pylist()])
        same = first == table.column("two")[0].as_py()
        node, n, x = table.column("node").to_numpy(), table.column("n").to_numpy(), unit(_matrix(table.column("vector")))
        a, b = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            hit = x[rows] @ x[b].T >= threshold
            if same:
                hit &= rows[:, None] != b
            links[rows] += hit @ n[b]
            if not same:
                links[b] += n[rows] @ hit
            # one edge from each row that hits, and one to each column that is hit, span the classes
            r, c = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            merge_labels(label, rows[r], b[hit[r].argmax(1)])
            merge_labels(label, rows[hit[:, c].argmax(0)], b[c])
            far = hit & (label[rows][:, None] != label[b])
            if far.any():
                i, j = np.nonzero(far)
                merge_labels(label, rows[i], b[j])
        some = np.flatnonzero(links > 0)
        return pa.table({"a": node[some], "b": node[label[some]], "links": links[some]})

    return ends.join(members, "grp").select("one", "two", "grp", "node", "vector", "n").groupBy("one", "two").applyInArrow(run, "a bigint, b bigint, links bigint")


def _undecided(odd: DataFrame, nodes: DataFrame, member_of: DataFrame, threshold: float) -> DataFrame:
    """``_compared`` for pairs of balls (a, b), cut into groups of BLOCK_ROWS members at most on average."""
    in_odd = odd.select(F.col("a").alias("ball")).unionAll(odd.select(F.col("b").alias("ball"))).distinct()
    balls = stored(member_of.join(in_odd, "ball").groupBy("ball").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")), "vector-odd")
    named = lambda ball, part: F.concat_ws("/", ball, part)
    placed_ = member_of.join(balls, "ball").select("node", named(F.col("ball"), F.pmod(F.xxhash64("node"), F.col("parts"))).alias("grp"))
    members = stored(nodes.select("node", "vector", "n").join(placed_, "node").select("grp", "node", "vector", "n"), "vector-odd")
    groups = balls.select("ball", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("ball", named(F.col("ball"), F.col("part")).alias("grp"))
    pairs = odd.join(groups.select(F.col("ball").alias("a"), F.col("grp").alias("one")), "a").join(groups.select(F.col("ball").alias("b"), F.col("grp").alias("two")), "b")
    return _compared(members, pairs.select("one", "two"), threshold)


def _by_graph(nodes: DataFrame, member_of: DataFrame, balls: DataFrame, clusters: Clusters, threshold: float, overlap: float, beam: int, far: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) and edges (a, b) between nodes, from a search of the graph of balls."""
    dealt = stored(_deal(balls.select("ball", "n", "rho", "root", "vector"), clusters, overlap), "vector-shards")
    lists = stored(dealt.select("shard", "ball", "vector").groupBy("shard").applyInArrow(_builder(far), "shard string, ball bigint, near array<bigint>"), "vector-graph")
    several = stored(lists.groupBy("ball").agg(F.count("*").alias("shards")).where("shards > 1").select("ball"), "vector-several")
    united = lists.join(several, "ball", "left_semi").groupBy("ball").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    graph = lists.join(several, "ball", "left_anti").select("shard", "ball", "near").unionAll(lists.select("shard", "ball").join(united, "ball").select("shard", "ball", "near"))
    found = stored(dealt.groupBy("shard").cogroup(graph.groupBy("shard")).applyInArrow(_searcher(threshold, beam), "a bigint, b bigint, links bigint"), "vector-links")
    odd = stored(found.where("links IS NULL").select("a", "b").distinct(), "vector-pairs")
    more = stored(_undecided(odd, nodes, member_of, threshold), "vector-links")
    whole = found.where("links > 0").groupBy(F.col("a").alias("ball")).agg(F.sum("links").alias("whole"))
    single = more.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("single"))
    sizes = stored(balls.select("ball", F.col("n").alias("members")).join(whole, "ball", "left").select("ball", (F.col("members") + F.coalesce("whole", F.lit(0))).alias("of_ball")), "vector-counts")
    links = nodes.select("node").join(member_of, "node").join(sizes, "ball").join(single, "node", "left").select("node", (F.col("of_ball") - 1 + F.coalesce("single", F.lit(0))).alias("links"))
    edges = found.where("links IS NOT NULL").select("a", "b").unionAll(more.select("a", "b")).unionAll(member_of.select(F.col("node").alias("a"), F.col("ball").alias("b")))
    return links, edges


def _by_blocks(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As ``_by_graph``, by comparison of all blocks of a label: exact."""
    parts = stored(nodes.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")), "vector-blocks")
    named = lambda part: F.concat_ws("#", "root", part)
    members = nodes.join(parts, "root").select(named(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("grp"), "node", "vector", "n")
    one = parts.select("root", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    pairs = one.select("root", "p", F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("q")).select(named(F.col("p")).alias("one"), named(F.col("q")).alias("two"))
    found = stored(_compared(stored(members, "vector-blocks"), pairs, threshold), "vector-links")
    single = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("single"))
    return nodes.select("node", "n").join(single, "node", "left").select("node", (F.coalesce("single", F.lit(0)) + F.col("n") - 1).alias("links")), found.select("a", "b")


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, size: int) -> float | None:
    """Lesser share of true links found, over all links and on average over nodes, of a sample of nodes that meets all nodes in blocks."""
    every = nodes.join(links, "node")
    order = [F.xxhash64(F.lit("audit"), "node"), "node"]
    linked = every.where("links > 0").orderBy(*order).limit(size // 2).collect()
    picked = {r.node: r for r in [*linked, *every.orderBy(*order).limit(size // 2).collect()]}
    by: dict[str, list] = {}
    for r in picked.values():
        by.setdefault(r.root, []).append((r.node, r.vector))
    by_unit = {g: (np.array([v[0] for v in r]), unit(np.array([v[1] for v in r]))) for g, r in by.items()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            for root, rows, x in _by_root(b):
                if root in by_unit:
                    ids, vectors = by_unit[root]
                    hit = x @ vectors.T >= threshold
                    true = n[rows] @ hit - (node[rows][:, None] == ids).any(0)  # no vector links with itself
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true.astype(np.int64))], ["node", "true"])

    shares, true_links, found_links = [], 0, 0
    for r in nodes.select("n", "node", "root", "vector").mapInArrow(run, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true")).collect() if picked else ():
        if r.true:
            found = min(r.true, picked[r.node].links)
            shares.append(found / r.true)
            true_links, found_links = true_links + r.true, found_links + found
    return min(found_links / true_links, sum(shares) / len(shares)) if shares else None


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, want_recall: float = 0.95, attempts: int = 2,
    shard: int = SHARD, overlap: float = OVERLAP, beam: int = BEAM,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) per row."""
    e = F.col("vector")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>").alias("vector"))
    usable = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite, F.lit(False))
    keyed = rows.withColumns({"usable": usable, "root": F.concat_ws("/", "label", F.size("vector")), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    # equal vectors by 128 bits of hash; the vector is no key of any shuffle
    nodes = keyed.where("usable").groupBy("root", "h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "root", "h1", "h2", "n", "least", "vector"), "vectors")
    member_of = stored(_balls(nodes, math.acos(threshold) / 2 - 2 * EPSILON), "vector-members")
    sizes = nodes.select("node", "n").join(member_of, "node").groupBy("ball").agg(F.sum("n").alias("n"), F.max("angle").alias("rho"))
    balls = stored(nodes.select(F.col("node").alias("ball"), "root", "vector").join(sizes, "ball").select("ball", "n", "rho", "root", "vector"), "vector-balls")
    clusters, far, recall = _clusters(balls.select(F.col("ball").alias("id"), "root", "vector"), shard), FAR_CANDIDATES, None
    for _ in range(attempts):
        links, edges = _by_graph(nodes, member_of, balls, clusters, threshold, overlap, beam, far)
        links = stored(links, "vector-counts")
        recall = _audit(nodes, links, threshold, AUDIT)
        if recall is None or recall >= want_recall:
            break
        overlap, beam, far = 2 * overlap, 2 * beam, 2 * far
    else:
        links, edges = _by_blocks(nodes, threshold)
        links, recall = stored(links, "vector-counts"), 1.0
    roots = connected_components(edges, "vectors")
    classes = stored(nodes.select("node", "root", "h1", "h2", "least").withColumnRenamed("root", "grp").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "vector-classes")
    component = stored(classes.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    per_node = stored(classes.join(component, "root").join(links, "node").select(F.col("grp").alias("root"), "h1", "h2", "links", "component_id"), "vector-results")
    own = F.coalesce("component_id", "vec_id")
    some = keyed.where("usable").select("vec_id", "root", "h1", "h2").join(per_node, ["root", "h1", "h2"]).select("vec_id", "links", own.alias("component_id"))
    none = keyed.where(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component_id"))
    out = some.unionAll(none)
    return out.select("vec_id", F.col("links").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall if recall is None else round(recall, 4)).cast("double").alias("audit_recall"))


def op7_flat_graph(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
