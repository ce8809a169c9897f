"""Cross-site lines against SQL and a plain version."""

from . import brute
from rawscan.llm import line_spread as L


def plain(rows, min_sites=3):
    """(id, text after, lines, removed) per (id, text, site) row."""
    sites, keeper = {}, {}
    for i, text, site in rows:
        for line in text.split("\n") if text is not None else ():
            if line.strip(" "):
                sites.setdefault(line, set()).add(site or "")
                keeper[line] = min((k for k in (keeper.get(line), i) if k is not None), default=None)
    out = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        left = [x for x in lines if len(sites.get(x, ())) < min_sites or keeper[x] == i]
        out.append((i, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted(((r.doc_id, r.text, r["__lines"], r["__removed"]) for r in L.remove_boilerplate(docs, **options).select("doc_id", "text", "__lines", "__removed").collect()), key=repr)


def test_sql(spark, compare):
    got, want = compare(L.op9_line_spread(spark, brute.SF), L.SQL, brute.SF)
    assert got == want and sum(r[2] for r in got) > 0


def test_every_spread_around_the_threshold(spark):
    rows = [(100 * n + i, f"own {n} {i}\nshared by {n}\n\nlast", f"site{i}") for n in range(1, 40) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for m in (2, 3, 20):
        assert found(docs, min_sites=m) == plain(rows, m)


def test_edges(spark):
    rows = brute.edge_rows() + [(20 + i, "a\na\nb\n \n", f"x{i}", f"x{i}", 8) for i in range(4)] + [(None, "only null ids", "en", f"n{i}", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    assert found(docs) == plain([(r[0], r[1], r[3]) for r in rows])
    assert L.remove_boilerplate(docs.limit(0)).collect() == []
    more = brute.with_clashes(docs)
    out = L.remove_boilerplate(more)
    assert out.columns[: len(more.columns)] == more.columns and out.count() == len(rows) and out.columns[-2:] == ["___lines", "___removed"]
