"""Personal data: fixed patterns, and further spans by weak supervision.

Base kinds (email, ip, card, phone) are exact patterns with checks. Further candidates (account,
tel, ssn, iban, name, street) that overlap no base span get three votes each, for, against or none:

* regex: the strict form or checksum of the kind;
* gazetteer: fixed public lists (issuer prefixes, country codes, first names) and the corpus itself: area codes of valid
  phone numbers, prefixes of valid cards and parts of mail addresses that at least ``KNOWN_IN`` documents have;
* context: cue words just before, for or against, or a base span close by.

Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable each
labeler is per class; its posteriors are the soft labels of a logistic classifier of the votes, the
kind, the length, the words on either side and the distance to the next base span. It is fitted
on at most ``TRAIN`` candidates (those of least hash); every candidate is then judged, and those it accepts
become spans. What reaches the driver is a row per vote pattern (under 200) and that sample.

Texts that hold no character sequence any pattern could begin with are passed over by one regular expression
in the JVM and never reach Python.

Defined results: a null text counts as empty; texts of any length are searched whole; offsets count code
points, end exclusive; spans that start at the same place are in order of kind; repeated rows each give
a row and each count as evidence; no candidates: no added spans; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "tel", "ssn", "iban", "name", "street")
TRAIN = 20_000
KNOWN_IN = 2
NEAR = 80  # characters around a candidate that count as close by
WORDS = 256  # hash places of the words on either side
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no match starts inside a run of digits; saying so keeps long runs linear
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: fixed values: common first names, street words, IBAN countries, card issuers' first digits
FIRST_NAMES = frozenset(
    "James Mary John Anna Peter Maria Paul Laura Michael Sarah David Julia Thomas Emma Robert Linda William Susan Richard Karen Daniel Lisa Mark Nancy George Helen Hans Klaus Sabine Jürgen Monika Stefan Petra "
    "Pierre Marie Jean Luc Claire Sophie François Nathalie Juan Carlos Carmen José Ana Luis Pilar Javier Lucía Miguel".split()
)
STREETS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court")
IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Sra")
FOR = {
    "account": ("account", "card", "konto", "compte", "cuenta", "carte", "karte", "tarjeta"), "tel": ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono"), "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"), "name": ("name", "dear", "contact", "signed", "author"), "street": ("address", "live", "ship", "home", "adresse"),
}
AGAINST = ("version", "order", "isbn", "ref", "serial", "page", "part", "model", "ticket", "invoice", "sku", "timestamp", "http", "chapter")
_CANDIDATES = {
    "account": re.compile(r"(?<![A-Za-z0-9.+_-])[0-9](?:[\x20-]?[0-9]){10,25}(?![A-Za-z0-9_]|[.-][0-9])"),
    "tel": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(r"(?<![A-Za-z])(?:(?:" + "|".join(TITLES) + r")\.?\x20|(?<=[Nn]ame:\x20)|(?<=[Dd]ear\x20)|(?<=ontact:\x20))[A-ZÀ-Þ][a-zà-ÿ]+(?:\x20[A-ZÀ-Þ][a-zà-ÿ]+)?"),
    "street": re.compile(r"(?<![0-9])[0-9]{1,4}\x20[A-Z][a-z]+\x20(?:" + "|".join(STREETS) + ")(?![a-z])"),
}
#: no text without this holds a base match or a candidate (Java's syntax)
ANY = r"@|[0-9]\.[0-9]|\+[0-9]|[0-9][0-9A-Z .()-]{8}|[Nn]ame: |[Dd]ear |ontact: |(?:" + "|".join(TITLES) + r")[. ]|[0-9] [A-Z][a-z]+ (?:" + "|".join(STREETS) + ")"
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of valid base matches, in order; failed matches use up their text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _form(kind: str, s: str) -> int:
    """The regex labeler: 1 for, 0 against, 2 neither."""
    d = _digits(s)
    if kind == "account":
        return 0 if len(set(d)) <= 2 or not 12 <= len(d) <= 19 else 1 if len(d) == 16 else 2
    if kind == "tel":
        return int(d[0] not in "01" and d[3] not in "01")
    if kind == "ssn":
        return int(d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")
    if kind == "iban":
        return int(_iban_ok(s))
    if kind == "name":
        return 1 if " " in s.removeprefix(s.split(" ")[0] + " ") or s.split(" ")[0].rstrip(".") not in TITLES else 2
    return 1 if s.split(" ")[0] != "0" else 0


def _listed(kind: str, s: str) -> int:
    """The gazetteer labeler's fixed lists."""
    if kind == "account":
        return 1 if s.startswith(ISSUERS) else 2
    if kind == "tel":
        return 0 if _digits(s)[3:6] == "555" and _digits(s)[6:8] == "01" else 2  # reserved for fiction
    if kind == "iban":
        return int(s[:2] in IBAN_COUNTRIES)
    if kind == "name":
        words = [w for w in s.replace(".", " ").split() if w not in TITLES]
        return 1 if words[0] in FIRST_NAMES else 0 if words[0] in STREETS else 2
    return 2


def known_as(kind: str, s: str) -> str:
    """What a candidate is looked up by in the gazetteer of the corpus."""
    d = _digits(s)
    if kind == "tel":
        return f"tel:{d[:3]}"
    if kind == "account":
        return f"account:{d[:2]}"
    if kind == "name":
        return f"name:{s.split(' ')[-1].lower()}"
    return ""


def evidence(text: str, base: list[tuple[int, int, int]]) -> list[str]:
    """What the valid base spans of a text teach the gazetteer."""
    out = set()
    for start, rank, end in base:
        s = text[start:end]
        if rank == 0:
            out.update(f"name:{w.lower()}" for w in _WORD.findall(s.split("@")[0]) if len(w) > 2)
        elif rank == 2:
            out.add(f"account:{_digits(s)[:2]}")
        elif rank == 3 and len(_digits(s)) >= 10:
            out.add(f"tel:{_digits(s)[-10:-7]}")
    return sorted(out)


def _place(word: str, side: int) -> int:
    return 4 + zlib.crc32(f"{side}{word.lower()}".encode("utf-8", "surrogatepass")) % WORDS + WORDS * side


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int, str, list[int]]]:
    """(start, rank of kind, end, regex vote, listed vote, context vote, gazetteer key, features), in order."""
    out = []
    starts, ends = [s for s, _, _ in base], np.maximum.accumulate([0, *[e for _, _, e in base]]).tolist()  # base spans may overlap: the furthest end so far
    for k, kind in enumerate(ADDED):
        for m in _CANDIDATES[kind].finditer(text):
            a, b = m.span()
            i = bisect.bisect_left(starts, b)  # base spans that begin before the end
            if ends[i] > a:
                continue
            before = text[max(0, a - 40) : a].lower()
            gap = min(a - ends[i] if i else 1 << 30, starts[i] - b if i < len(starts) else 1 << 30)
            if any(w in before for w in AGAINST):
                context = 0
            else:
                context = 1 if any(w in before for w in FOR[kind]) or gap <= NEAR else 2
            left, right = _WORD.findall(text[max(0, a - 30) : a]), _WORD.search(text[b : b + 30])
            feats = [0 if gap <= NEAR else 1 if gap <= 10 * NEAR else 2, *([_place(left[-1], 0)] if left else []), *([_place(right[0], 1)] if right else []), *([3] if b - a > 16 else [])]
            s = m[0]
            out.append((a, len(BASE) + k, b, _form(kind, s), _listed(kind, s), context, known_as(kind, s), feats))
    return sorted(out)


def pack(kind: int, votes: tuple[int, int, int]) -> int:
    return ((kind * 3 + votes[0]) * 3 + votes[1]) * 3 + votes[2]


def unpack(key: int) -> tuple[int, tuple[int, int, int]]:
    key, c = divmod(key, 3)
    key, b = divmod(key, 3)
    k, a = divmod(key, 3)
    return k, (a, b, c)


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """EM over vote patterns: P(personal) per key, and P(for | class, a vote is cast) as (kind, labeler, class).

    Before any data a vote is right at 0.7, with the weight of five; a labeler that would be worse than chance in a
    kind says nothing there, else the two classes could change places. A kind's share of personal ones is that of
    the majority of votes and stays: few labelers can't tell it from their own errors. To abstain says nothing."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kinds, v = np.array([unpack(k)[0] for k in keys]), np.array([unpack(k)[1] for k in keys])
    post = np.clip((v == 1).sum(1) / 3 - (v == 0).sum(1) / 3 + 0.5, 0.05, 0.95)
    table = np.zeros((len(ADDED), 3, 2))
    share = (np.bincount(kinds, n * post, len(ADDED)) + 1) / (np.bincount(kinds, n, len(ADDED)) + 2)
    for _ in range(rounds):
        logit = np.zeros(len(keys))
        for j in range(3):
            for c, weight in enumerate((n * (1 - post), n * post)):
                yes, cast = np.bincount(kinds, weight * (v[:, j] == 1), len(ADDED)), np.bincount(kinds, weight * (v[:, j] != 2), len(ADDED))
                table[:, j, c] = (yes + (3.5 if c else 1.5)) / (cast + 5)
            worse = table[:, j, 1] < table[:, j, 0]
            table[worse, j] = table[worse, j].mean(1, keepdims=True)
            yes = np.log(table[kinds, j, 1] / table[kinds, j, 0])
            no = np.log((1 - table[kinds, j, 1]) / (1 - table[kinds, j, 0]))
            logit += np.where(v[:, j] == 1, yes, np.where(v[:, j] == 0, no, 0))
        post = 1 / (1 + np.exp(-np.clip(logit + np.log(share / (1 - share))[kinds], -30, 30)))
    return dict(zip(keys, post.tolist(), strict=True)), table


_CONTEXT_AT = 1 + len(ADDED) + 9 * len(ADDED)
WIDTH = _CONTEXT_AT + 4 + 2 * WORDS


def features(key: int, feats: list[int]) -> list[int]:
    """Places of the ones in a candidate's feature vector."""
    k, v = unpack(key)
    return [0, 1 + k, *[1 + len(ADDED) + 9 * k + 3 * j + v[j] for j in range(3)], *[_CONTEXT_AT + f for f in feats]]


def train(rows: list[tuple[int, list[int]]], posterior: dict[int, float], steps: int = 1000, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier, by gradient steps on soft labels."""
    w = np.zeros(WIDTH)
    if not rows:
        return w
    ones = [features(k, f) for k, f in rows]
    at, row = np.concatenate(ones).astype(np.int64), np.repeat(np.arange(len(ones)), [len(x) for x in ones])
    y, n = np.array([posterior[k] for k, _ in rows]), len(rows)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, w[at], n)))
        w += 0.8 * (np.bincount(at, (y - p)[row], WIDTH) / n - ridge * w)
    return w


_KINDS = (*BASE, *ADDED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_train: int = TRAIN) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(ANY), F.col(text_col)).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("form", pa.int32()), ("listed", pa.int32()), ("context", pa.int32()), ("known", pa.string()), ("feats", pa.list_(pa.int32()))]))
        names = ("start", "rank", "end", "form", "listed", "context", "known", "feats")
        nothing = hashlib.sha256(b"").hexdigest()
        for b in slices(batches, 1024):
            texts = b.column(2).to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            sha = [hashlib.sha256(",".join(f"{_KINDS[r]}:{s}:{e}" for s, r, e in x).encode()).hexdigest() if x else nothing for x in base]
            counts = [pa.array([sum(r == i for _, r, _ in x) for x in base], pa.int64()) for i in range(4)]
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t, x)] if t else [] for x, t in zip(base, texts, strict=True)]
            taught = pa.array([evidence(t, x) if x else [] for x, t in zip(base, texts, strict=True)], pa.list_(pa.string()))
            spans = pa.array([[{"start": s, "rank": r, "end": e} for s, r, e in x] for x in base], span)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, pa.array(sha), spans, pa.array(found, cand), taught], ["row", "doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "base", "cand", "taught"])

    shape = "start:int,rank:int,end:int"
    found = stored(
        rows.mapInArrow(run, f"row bigint, doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<{shape}>>, cand array<struct<{shape},form:int,listed:int,context:int,known:string,feats:array<int>>>, taught array<string>"), "pii"
    )
    known = stored(found.select(F.explode("taught").alias("known")).groupBy("known").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_IN).select("known"), "pii-known").withColumn("hit", F.lit(True))
    voted = found.where(F.size("cand") > 0).select("row", F.explode("cand").alias("c")).select("row", "c.*").join(known, "known", "left")
    listed = F.when(F.col("hit") & (F.col("listed") == 2), 1).otherwise(F.col("listed"))
    voted = stored(voted.select("row", "start", "rank", "end", ((((F.col("rank") - len(BASE)) * 3 + F.col("form")) * 3 + listed) * 3 + F.col("context")).alias("key"), "feats"), "pii-votes")
    counts = {r.key: r.n for r in voted.groupBy("key").agg(F.count("*").alias("n")).collect()}
    posterior = reliabilities(counts)[0] if counts else {}
    sample = voted.orderBy(F.xxhash64("row", "start", "rank"), "row", "start", "rank").limit(max_train).select("key", "feats").collect()
    weights = train([(r.key, r.feats) for r in sample], posterior)

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            score = [sum(weights[i] for i in features(k, f)) for k, f in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array([1 / (1 + np.exp(-s)) >= threshold for s in score], pa.bool_())) for i in range(4)], ["row", "start", "rank", "end"])

    good = voted.mapInArrow(judge, "row bigint, start int, rank int, end int").groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    out = found.join(good, "row", "left")
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kept = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<struct<{shape}>>"))))
    text = F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", text.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_added"))


def op5_pii(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
