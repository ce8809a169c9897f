"""Language of documents by Bayesian fusion of independent pieces of evidence.

log P(l | row) = tempered text likelihood + log P(declared | l) + log P(suffix | l) + log P(l | host)

The suffix is given by a column, or else is the last label of a host that is an address.

Text: a hashed character-trigram model per language, fitted on at most ``per_language``
whole documents of each declared language (those with the least id hashes: one per language
and hash bucket, with any rows that repeat its id). All of every text is scored; the sum is divided by the square
root of its length, since neighbouring trigrams are not independent. Class ``und`` is a
uniform model: it wins where no language explains the text, and such rows are rejected.

Host priors: counts of the languages that the texts alone suggest, over all rows, grouped
by host, by address suffix and in total; a host's rates are shrunk to its suffix's, those to
the total's, with ``alpha`` pseudo-rows each.

Defined results: a null text counts as empty and gives no text evidence; texts under three
characters neither; null host, suffix or declaration count as unknown; languages declared but
not asked for are ignored; with no evidence at all the prior decides and the row is kept;
an empty table gives an empty result; repeated rows each give a row; of rows with the same
id and text, ``keep_identified`` drops all if it rejects one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty, unused

LANGUAGES = ("de", "en", "es", "fr")
PER_LANGUAGE = 256
BUCKETS = 1 << 16
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.7
ALPHA = 20.0
STEP = 1 << 20
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "en": "en"}


def trigrams(text: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Hash bucket of each character trigram."""
    c = np.frombuffer(text[start:stop].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) if len(c) > 2 else np.empty(0, np.uint32)


def fit(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(buckets, languages + und) of log probabilities from each language's trigram counts, in order."""
    out = np.full((BUCKETS, len(counts) + 1), -np.log(BUCKETS), np.float32)
    for k, n in enumerate(counts.values()):
        if n.any():
            out[:, k] = np.log((n + 0.1) / (n + 0.1).sum())
        else:
            out[:, k] -= 5.0  # nothing to learn from
    return out


def score(text: str, table: np.ndarray) -> list[float]:
    """Log likelihood over the root of the number of trigrams, per class."""
    total, n = np.zeros(table.shape[1]), 0
    for at in range(0, max(len(text) - 2, 0), STEP):
        g = trigrams(text, at, at + STEP + 2)
        total += table[g].sum(0, dtype=np.float64)
        n += len(g)
    return (total / max(n, 1) ** 0.5).tolist()


def training_counts(docs: DataFrame, id_col: str, text_col: str, declared_col: str, languages: tuple[str, ...], per_language: int) -> dict[str, np.ndarray]:
    """Trigram counts of whole texts by declared language, at most ``per_language`` texts each. Texts are counted
    where they lie; only (language, bucket, count) rows, ``BUCKETS`` per language at most, reach the driver."""
    key = F.xxhash64(id_col)
    labelled = docs.where(F.col(declared_col).isin(*languages) & F.col(id_col).isNotNull())
    least = labelled.select(F.col(declared_col).alias("lang"), key.alias("h")).groupBy("lang", F.pmod("h", F.lit(per_language)).alias("bucket")).agg(F.min("h").alias("h")).collect()
    chosen = [r.h for r in least]
    out = {lang: np.zeros(BUCKETS) for lang in languages}
    if not chosen:
        return out

    def run(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for b in slices(batches, 16):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for at in range(0, max(len(text) - 2, 0), STEP):
                    n += np.bincount(trigrams(text, at, at + STEP + 2), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    texts = labelled.where(key.isin(*chosen)).select(F.col(declared_col).alias("lang"), text_or_empty(text_col).alias("text"))
    for r in texts.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.lang][r.bucket] = r.n
    return out


def _evidence(known: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log P(what is said | class), an array over languages and und; zeros where nothing usable is said."""
    wrong = (1 - right) / max(len(languages) - 1, 1)
    given = F.array(*[F.when(known == lang, float(np.log(right))).otherwise(float(np.log(wrong))) for lang in languages], F.lit(float(-np.log(len(languages)))))
    return F.when(known.isin(*languages), given).otherwise(F.array(*[F.lit(0.0)] * (len(languages) + 1)))


def host_suffix(host: Column) -> Column:
    """Last label of a host with a dot, whatever port or path follows; '' for other names."""
    return F.regexp_extract(F.lower(host), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#:]*\.([a-z]+)\.?(?:[:/?#]|$)", 1)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source", suffix_col: str | None = None,
    languages: tuple[str, ...] = LANGUAGES, per_language: int = PER_LANGUAGE, alpha: float = ALPHA,
) -> DataFrame:
    """(doc_id, text_hash, text_lang, lang_id, posterior, kept) per row."""
    table = fit(training_counts(docs, id_col, text_col, declared_col, languages, per_language))
    host = F.coalesce(F.col(host_col).cast("string") if host_col else F.lit(None).cast("string"), F.lit(""))
    suffix = F.coalesce(F.col(suffix_col).cast("string"), F.lit("")) if suffix_col else host_suffix(host)
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(declared_col).cast("string").alias("declared"),
        host.alias("host"), suffix.alias("suffix"),
        text_or_empty(text_col).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            scores = [score(t, table) for t in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(scores, pa.list_(pa.float64()))], ["id", "text_hash", "declared", "host", "suffix", "ll"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = stored(rows.mapInArrow(run, f"id {id_type}, text_hash bigint, declared string, host string, suffix string, ll array<double>"), "language-scores")
    classes = [*languages, "und"]
    k = len(classes)
    top = F.array_position("ll", F.array_max("ll")) - 1
    informed = F.array_max("ll") > F.array_min("ll")
    counts = [F.count_if(informed & (top == i)).cast("double").alias(f"n{i}") for i in range(k)]
    by_host = stored(scored.groupBy("host", "suffix").agg(*counts), "language-hosts")
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(k)])
    total = by_host.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(k)]).first()
    base = (np.array(total, float) + 1) / (sum(total) + k)
    of_suffix = [(F.col(f"s{i}") + alpha * float(base[i])) / (sum(F.col(f"s{j}") for j in range(k)) + alpha) for i in range(k)]
    of_host = [(F.col(f"n{i}") + alpha * of_suffix[i]) / (sum(F.col(f"n{j}") for j in range(k)) + alpha) for i in range(k)]
    priors = by_host.join(by_suffix, "suffix").select("host", "suffix", F.array(*[F.log(p) for p in of_host]).alias("prior"))
    by_path = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    said = [_evidence(F.col("declared"), tuple(languages), DECLARED_RIGHT), _evidence(by_path[F.col("suffix")], tuple(languages), SUFFIX_RIGHT)]
    joined = scored.join(priors, ["host", "suffix"], "left").withColumns({"d": said[0], "s": said[1]})
    fused = F.transform("ll", lambda x, i: x + F.get("d", i) + F.get("s", i) + F.coalesce(F.get("prior", i), F.lit(0.0)))
    joined = joined.withColumn("post", fused).withColumn("best", F.array_max("post"))
    names = F.array(*[F.lit(c) for c in classes])
    lang = F.get(names, (F.array_position("post", F.col("best")) - 1).cast("int"))
    weight = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return joined.select(
        F.col("id").alias("doc_id"), "text_hash", F.when(informed, F.get(names, top.cast("int"))).alias("text_lang"), lang.alias("lang_id"), F.round(1.0 / weight, 6).alias("posterior"), ((lang != "und") | ~informed).alias("kept")
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    gone_id, gone_hash = unused(docs, "__id"), unused(docs, "__hash")
    out = stored(identify(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(), "language-rejected")
    return docs.join(out, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_hash)), "left_anti")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``identify``: declared markup language, host and suffix (the path's language, or else the last label)."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    label = F.regexp_extract(host, r"([a-z]+)$", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]{2})""", 1))
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("lang"), host.alias("source"), F.when(path != "", path).otherwise(label).alias("suffix"))


def op3_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


def language_id_pages(spark, sf_dir):
    """As ``op3_language_id``, of pages: the operator on rows with markup language, host and suffix."""
    out = identify(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), suffix_col="suffix").drop("text_hash")
    return out.withColumnRenamed("doc_id", "page_id")
