"""Slow, plain versions of the operators, for comparison."""

import hashlib
import re

import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def digest(spans):
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()


def secret_spans(text):
    out = []
    word = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    word = re.sub(r"(?<=[(|])[a-z_?]+(?=[|)])", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), word)
    for m in re.finditer(word, text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        if i % 2:
            d *= 2
            if d > 9:
                d -= 9
        total += d
    return total % 10 == 0


def pii_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text, n):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def simhash(text, n=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    """item -> least item reachable."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in items:
        for j in items:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def edit_in(pattern, text):
    """Least edit distance of pattern to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edge_rows():
    """Null columns, empty, blank, very long, repeated and tied rows."""
    long = "lorem ipsum dolor sit amet " * 40_000
    return [
        (None, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (1, None, None, None, None), (2, "", "en", None, 0), (3, "  \n\t ", None, "s", 5), (4, "x", "xx", "s", 1),
        (5, long, "en", "s", len(long)), (6, long, "en", "t", len(long)), (7, "same words here\nsecond line", "en", "s", 27), (7, "same words here\nsecond line", "en", "s", 27),
        (8, "same words here\nsecond line", "fr", "t", 27), (9, "same words here", "de", "u", 15), (10, "żółć 漢字 😀 ▁ \u0000 end", "es", "u", 17),
    ]


def with_clashes(df):
    """More columns, named like the operators' own."""
    from pyspark.sql import functions as F

    for c in ("id", "row", "fp", "root", "h1", "line", "pos", "label_", "__id", "__hash", "__odd", "__removed", "__lines", "__positions", "__lines_array", "__text_hash", "text_hash", "key", "node"):
        df = df.withColumn(c, F.lit("clash"))
    return df
