"""URL filter: given host/path rules first, else association rules mined with FP-growth.

URLs that a given rule decides are the labelled examples. Their tokens (host labels, path
words, query names) and verdict form transactions; FP-growth finds frequent combinations,
and rules ``tokens -> verdict`` are kept by support and confidence, less those that a
shorter rule predicts as well. Other URLs are matched through an inverted index from each
rule's rarest token; the rule of greatest (confidence, support) decides, none means allow.

All distinct labelled URLs train the miner, with all their frequent tokens, at one support for sets of any size.
Each frequent token's conditional patterns go to one task, which grows them through FP-trees. Only sets that can
make no kept rule are passed over: tokens that occur in the same labelled URLs are mined as one; a token
that all URLs of a set have adds nothing to it; a set of one verdict only cannot be bettered; nor can one whose URLs
with all tokens still to come hold too many of the other verdict. What is left may grow exponentially with the number
of frequent tokens that go together at random and tell nothing; no bound cuts it.
The driver and the index shipped to tasks hold the frequent tokens and the rules.
Every URL is judged, with all its tokens.

Defined results: a null url or one without "://" has empty host and path and matches no
given rule; of mined rules that fit, ties in confidence and support go to the fewer tokens, then to the
later in order of tokens; urls of any length are split whole; repeated rows each give a row and are learnt from once;
without labelled URLs nothing is mined and what no given rule decides is allowed; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null; for rule lists that fit in a plan."""
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = "/" + p
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h:label, p:word (digits as #), q:name."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.regexp_replace(path, "[0-9]+", "#"), "[^A-Za-z#]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_sort(F.filter(F.array_distinct(F.concat(labels, words, names)), lambda t: F.length(t) > 2))


@dataclass(frozen=True)
class Rule:
    tokens: frozenset
    verdict: str
    confidence: float
    support: int

    def key(self):
        return (self.confidence, self.support, -len(self.tokens), sorted(self.tokens), self.verdict)


def grown(body: tuple, paths: list, total: list, least: float, min_confidence: float, best: list) -> Iterator[tuple]:
    """(tokens, verdict, URLs with both, URLs with the tokens) of rules of ``body`` and more tokens, each more confident than those it was grown from.

    ``paths``: (tokens, URLs by verdict) that occur with ``body``; ``total``: URLs of ``body`` by verdict; ``best``: confidence so far by verdict."""
    rows, best = sum(total), list(best)
    for v, m in enumerate(total):
        if m >= least and m / rows >= min_confidence and m / rows > best[v]:
            best[v] = m / rows
            yield body, v, m, rows
    if max(total) == rows:
        return
    with_token: dict = {}
    for path, by in paths:
        for x in path:
            have = with_token.setdefault(x, [0] * len(total))
            for v, m in enumerate(by):
                have[v] += m
    with_token = {x: by for x, by in with_token.items() if max(by) >= least and sum(by) < rows}
    always = [0] * len(total)  # URLs that stay, whichever tokens are added
    for path, by in paths:
        if sum(x in with_token for x in path) == len(with_token):
            always = [a + m for a, m in zip(always, by, strict=True)]
    most = [m / (m + sum(always) - a) if m else 0.0 for m, a in zip(total, always, strict=True)]
    hope = [v for v, m in enumerate(total) if m >= least and most[v] >= min_confidence and most[v] > best[v]]
    order = sorted((x for x, by in with_token.items() if any(by[v] >= least for v in hope)), key=lambda x: (-sum(with_token[x]), x))
    rank = {x: k for k, x in enumerate(order)}
    # the FP-tree: a node per beginning of an ordered path
    token, parent, count, child, heads = [-1], [-1], [[0] * len(total)], {}, {x: [] for x in order}
    for path, by in paths:
        node = 0
        for x in sorted((x for x in path if x in rank), key=rank.__getitem__):
            at = child.get((node, x))
            if at is None:
                at = child[node, x] = len(token)
                token.append(x)
                parent.append(node)
                count.append([0] * len(total))
                heads[x].append(at)
            node = at
            for v, m in enumerate(by):
                count[node][v] += m
    for x in reversed(order):
        before = []
        for node in heads[x]:
            path, at = [], parent[node]
            while at:
                path.append(token[at])
                at = parent[at]
            before.append((path, count[node]))
        yield from grown((*body, x), before, with_token[x], least, min_confidence, best)


def mine_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[list[Rule], dict[str, str]]:
    """Rules over classes of tokens that occur in the same labelled URLs, each named by one of its tokens; and the class of each frequent token.

    A rule holds for any choice of a token of each class. ``labelled``: url, tokens, verdict, which follow from the url."""
    train = stored(labelled.select("url", "verdict", F.array_distinct("tokens").alias("tokens")).dropDuplicates(["url"]), "url-train")
    sizes = {r.verdict: r.n for r in train.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    names, n = sorted(sizes), sum(sizes.values())
    if not n:
        return [], {}
    least = min_support * n
    marks = train.select(F.explode("tokens").alias("t"), F.xxhash64("url").alias("a"), F.xxhash64(F.lit(1), "url").alias("b"))
    often = marks.groupBy("t").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least).collect()
    members: dict[tuple, list[str]] = {}
    for r in often:
        members.setdefault((-r.n, r.a, r.b), []).append(r.t)
    classes = sorted((key[0], max(tokens), tokens) for key, tokens in members.items())
    reps = [rep for _, rep, _ in classes]

    def known(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            found = pc.index_in(b.column(0).flatten(), value_set=pa.array(reps, pa.string()))
            keep = found.is_valid().to_numpy(zero_copy_only=False)
            row, rank = pc.list_parent_indices(b.column(0)).to_numpy()[keep], found.drop_null().to_numpy()
            at = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(at), pa.array(rank[np.lexsort((rank, row))], pa.int32()))
            yield pa.RecordBatch.from_arrays([items, b.column(1)], ["items", "verdict"])

    def grow(table):
        import pyarrow as pa

        paths = list(zip(table.column("before").to_pylist(), table.column("n").to_pylist(), strict=True))
        total = [sum(by) for by in zip(*(by for _, by in paths), strict=True)]
        rules = list(grown((table.column("item")[0].as_py(),), paths, total, least, min_confidence, [0.0] * len(total)))
        shape = pa.schema([("body", pa.list_(pa.int32())), ("verdict", pa.int32()), ("support", pa.int64()), ("urls", pa.int64())])
        return pa.Table.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rules], shape)

    by = [f"n{k}" for k in range(len(names))]
    sets = train.select("tokens", "verdict").mapInArrow(known, "items array<int>, verdict string").groupBy("items").agg(*[F.count_if(F.col("verdict") == v).alias(c) for v, c in zip(names, by, strict=True)])
    each = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.slice("items", 1, i).alias("before")))
    parts = sets.select(*by, F.explode(each).alias("e")).groupBy("e.item", "e.before").agg(*[F.sum(c).alias(c) for c in by])
    bases = parts.select("item", "before", F.array(*by).alias("n"))
    # a number of its own, as few bytes may hold much work: adaptive execution would put them into one task
    wide = max(1, min(len(reps), 4 * train.sparkSession.sparkContext.defaultParallelism))
    grew = bases.repartition(wide, "item").groupBy("item").applyInArrow(grow, "body array<int>, verdict int, support bigint, urls bigint")
    found = [Rule(frozenset(reps[x] for x in r.body), names[r.verdict], r.support / r.urls, r.support) for r in grew.collect()]
    rank = {rep: k for k, rep in enumerate(reps)}
    kept: list[Rule] = []
    index: dict[str, list[Rule]] = {}
    for r in sorted(found, key=lambda r: (len(r.tokens), *r.key())):
        if not any(s.verdict == r.verdict and s.confidence >= r.confidence and s.tokens <= r.tokens for t in r.tokens for s in index.get(t, ())):
            kept.append(r)
            index.setdefault(max(r.tokens, key=rank.__getitem__), []).append(r)
    return kept, {t: rep for _, rep, tokens in classes for t in tokens}


def mine(labelled: DataFrame, max_train: int | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_sets: int | None = None) -> list[Rule]:
    """The rules of ``mine_classes``, one for each choice of tokens. ``max_train`` and ``max_sets``, bounds of an earlier version, are taken and bound nothing."""
    rules, class_of = mine_classes(labelled, min_support, min_confidence)
    tokens: dict[str, list[str]] = {}
    for t, rep in class_of.items():
        tokens.setdefault(rep, []).append(t)
    return [Rule(frozenset(choice), r.verdict, r.confidence, r.support) for r in rules for choice in itertools.product(*(tokens[t] for t in r.tokens))]


class Index:
    """Rules by their rarest token (rarest among the rules themselves); ``class_of``: the token that stands for others in the rules."""

    def __init__(self, rules: list[Rule], class_of: dict[str, str] | None = None):
        self.class_of = class_of or {}
        uses: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                uses[t] = uses.get(t, 0) + 1
        self.by_token: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_token.setdefault(min(r.tokens, key=lambda t: (uses[t], t)), []).append(r)

    def best(self, tokens) -> Rule | None:
        have: dict[str, str] = {}  # of a class, the last in order
        for t in sorted(tokens):
            have[self.class_of.get(t, t)] = t
        fits = (r for c in have for r in self.by_token.get(c, ()) if have.keys() >= r.tokens)
        return max((Rule(frozenset(have[c] for c in r.tokens), r.verdict, r.confidence, r.support) for r in fits), key=Rule.key, default=None)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) per row."""
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    ruled = parts.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    mined, class_of = mine_classes(ruled.where("given is not null").select("url", "tokens", F.col("given.verdict").alias("verdict")), **options)

    def run(batches):
        import pyarrow as pa

        index, seen = Index(mined, class_of), {}
        for b in batches:
            out = []
            for given, tokens in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                if given is not None:
                    out.append((given, None, None))
                    continue
                key = tuple(tokens)
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    r = index.best(tokens)
                    seen[key] = (r.verdict, " ".join(sorted(r.tokens)), r.confidence) if r else ("allow", None, None)
                out.append(seen[key])
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), *columns], ["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"])

    id_type = pages.schema[id_col].dataType.simpleString()
    flat = ruled.select("page_id", "host", "path", F.col("given.verdict").alias("given"), F.col("given.rule").alias("rule"), "tokens")
    return flat.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, mined_rule string, confidence double")


def op4_url_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
