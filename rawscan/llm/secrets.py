"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Candidates are found by fixed patterns; each value's hash is counted over all documents by
distinct owner and distinct repository. A value that one owner has alone is live-looking,
in however many of its repositories; so is one on at most ``max_owners`` owners in at most
``max_repositories`` repositories in all. Any other is a widely copied example. Spans of the base kinds (assign,
access, hex) always stay; spans of the added kinds (prefixed, jwt, pem, mixed) are reported where the
value is live-looking. Offsets count code points, end exclusive.

``documents`` names no repository: the query takes its source as the owner and source/lang as the repository.

Defined results: a null text counts as empty; null owner or repository count as one unknown
(''); texts of any length are searched whole, in time linear in their spans; spans that start at the same place
are in order of kind; repeated rows each give a row and share their owner; a null id is carried
through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": ("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: the same spans, cheaper: an access key or hex run that is too short hides no longer one
FAST = {"access": "AKIA[A-Z0-9]{12,}", "hex": "(?<![0-9a-f])[0-9a-f]{32,}"}
ADDED = {
    "prefixed": (r"(?<![A-Za-z0-9])(?:gh[opsu]_|glpat-|xox[bp]-|sk_live_)[A-Za-z0-9_-]{16,}", 0, 0),
    "jwt": (r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*-----END [A-Z ]*PRIVATE KEY-----",
}
ADDED["pem"] = (ADDED["pem"], 0, 0)
#: long runs of upper case, lower case and digits together, as random keys have them
ADDED["mixed"] = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,40}[0-9])(?=[A-Z0-9+/_=-]{0,40}[a-z])(?=[a-z0-9+/_=-]{0,40}[A-Z])[A-Za-z0-9+/_=-]{24,}", 0, 0)
KINDS = [*BASE, *ADDED]
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
BLOCK = 256  # matches whose spans are gathered in one array before the arrays are joined
_SPAN = "array<struct<start:int,rank:int,end:int,hash:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, rank of kind, end, hash of the value) of one kind's valid matches."""
    pattern, group, least = {**BASE, **ADDED}[kind]
    pattern = FAST.get(kind, pattern)
    regex = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    none = F.array().cast(_SPAN)

    def step(acc, m):
        a = acc["at"] + F.length(m["gap"])
        b = a + F.length(m["hit"])
        one = F.array(F.struct(a.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), b.alias("end"), F.sha2(m["value"], 256).alias("hash")))
        good = m["hit"].isNotNull() & (F.length(m["value"]) >= least)
        return F.struct(F.coalesce(b, a).alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    # an array that grows by one copies itself each time: so a block's spans grow apart, and only blocks are appended
    def block(acc, matches):
        begun = F.struct(acc["at"].alias("at"), none.alias("spans"))
        return F.aggregate(matches, begun, step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["blocks"], F.array(x["spans"])).alias("blocks")))

    def in_blocks(matches):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda at: F.slice(matches, at, F.lit(BLOCK)))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))
    # bound to a variable, the matches are found once; a lambda evaluates whatever else it mentions each time
    blocks = F.flatten(F.transform(F.array(found), in_blocks))
    every = F.aggregate(blocks, begun, block, lambda acc: F.flatten(acc["blocks"]))
    return F.when(text.rlike(pattern), every).otherwise(none)


def _of_rank(rank: int):
    return lambda span: span["rank"] == rank  # one parameter only: a second would be the index


def _text_of(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: Column | None = None) -> DataFrame:
    """(row, doc_id, owner, repository, spans) with the spans of all kinds in order of (start, kind)."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(repository if repository is not None else F.lit(""), F.lit("")).alias("repository"), text_or_empty(text_col).alias("text"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.array_sort(reduce(F.concat, [spans_of(text, k) for k in KINDS])).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over all spans; each step combines before it shuffles."""
    each = found.select("owner", "repository", F.explode("spans.hash").alias("hash")).groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    return each.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, **columns) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repositories) per row.

    The last two are the greatest counts of any of the row's values, 0 where it has none."""
    found = stored(find(docs, **columns), "secrets")
    owned = stored(ownership(found), "secret-owners")
    verdict = found.select("row", F.explode("spans").alias("s")).join(owned, F.col("s.hash") == F.col("hash"))
    live = (F.col("owners") == 1) | (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    per_row = verdict.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
        F.collect_list(F.when(live & (F.col("s.rank") >= len(BASE)), F.col("s"))).alias("added"),
    )
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(_SPAN))))
    counts = [F.size(F.filter("spans", _of_rank(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(BASE)]
    totals = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")]
    return found.join(per_row, "row", "left").select("doc_id", *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(every).alias("spans"), *totals)


def op1_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, repository=F.concat_ws("/", "source", "lang"))
