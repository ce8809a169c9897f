"""Registry of the engine's queries over the test tables, each with an equivalent SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import bitmap_joint_count, bitmap_of, get_bit, lane_count, set_count
from .operators.engine import calibrated_search, search, stats, stats_report
from .operators.engine import search_stats as search_stats_of
from .operators.jsonquery import JsonQuery
from .operators.parse import execute, execute_files
from .operators.rawfilter import any_cascade, apply_cascade
from .plans.decompose import RawFilter, clamp, decompose, decompose_column
from .plans.literals import contains, custom, equals
from .plans.planner import calibrate, hit_patterns, joint_rate
from .sources.text import byte_range, read_records, read_whole, sample_head, scratch_path, split_records, write_records

PAIR = ["that", "with"]
TERMS = ["thatin", "ononst"]
PARSE_COST = 2000.0
LONG_TOKEN = "License, Version 9 of no document"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def raw_documents(spark, sf_dir) -> DataFrame:
    body = F.to_json(F.struct("doc_id", F.struct("lang", "source").alias("meta"), "text"))
    return docs(spark, sf_dir).select(body.alias("value"))


def raw_labels(spark, sf_dir) -> DataFrame:
    joined = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(F.to_json(F.struct("doc_id", "quality", (F.col("quality") == 1).alias("good"))).alias("value"))


def props(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))


RECORDS_SQL = "CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"


@query(f"SELECT doc_id, CAST(len({RECORDS_SQL}) AS BIGINT) AS records FROM documents")
def scan_records(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_size(split_records(F.col("text"))).cast("bigint").alias("records"))


@query("SELECT doc_id, CAST(len(CASE WHEN text LIKE '%.' THEN string_split(text, '.')[:-2] ELSE string_split(text, '.') END) AS BIGINT) AS records FROM documents")
def scan_records_custom_delim(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_size(split_records(F.col("text"), ".")).cast("bigint").alias("records"))


@query(f"SELECT doc_id, CAST(len(list_filter({RECORDS_SQL}, lambda x: x = '')) AS BIGINT) AS empty_records FROM documents")
def scan_empty_records(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_size(F.filter(split_records(F.col("text")), lambda r: r == "")).cast("bigint").alias("empty_records"))


@query("SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def scan_whole_text(spark, sf_dir):
    path = scratch_path(spark, "texts")
    docs(spark, sf_dir).select("lang", "text").write.partitionBy("lang").text(path)
    return read_whole(spark, path).groupBy("lang").agg(F.sum(F.length("value")).alias("chars"))


@query("SELECT doc_id, substr(hex(text), 201, 100) AS part FROM documents")
def scan_byte_range(spark, sf_dir):
    return byte_range(docs(spark, sf_dir).select("doc_id", "text"), 100, 50, "text").select("doc_id", F.hex("text").alias("part"))


def written(spark, sf_dir, delimiter: str = "\n") -> str:
    """Path of the documents' JSON records as text files."""
    path = scratch_path(spark, "records")
    write_records(raw_documents(spark, sf_dir), path, delimiter=delimiter)
    return path


@query("SELECT length(line) AS chars, count(*) AS records FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY length(line)")
def scan_files(spark, sf_dir):
    path = scratch_path(spark, "texts")
    write_records(docs(spark, sf_dir), path, "text")
    return read_records(spark, path).groupBy(F.length("value").cast("bigint").alias("chars")).agg(F.count("*").alias("records"))


@query("SELECT count(*) AS matches FROM documents WHERE contains(text, 'that') AND contains(text, 'with')")
def search_files(spark, sf_dir):
    return search(read_records(spark, written(spark, sf_dir, "\r\n"), "\r\n"), pair_query()).agg(F.count("*").alias("matches"))


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'that') AND contains(text, 'with')")
def json_reader_files(spark, sf_dir):
    q = pair_query().add_projection("doc_id", "int").add_projection("meta.source", alias="source")
    return execute_files(spark, written(spark, sf_dir), q)


@query("SELECT count(*) AS sampled, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1000)")
def sample_head_records(spark, sf_dir):
    head = sample_head(docs(spark, sf_dir).select("doc_id", "text"), 1000, "doc_id")
    return head.agg(F.count("*").alias("sampled"), F.sum(F.length("text")).alias("chars"))


QUERIES["sample_head"] = QUERIES.pop("sample_head_records")
ORACLE["sample_head"] = ORACLE.pop("sample_head_records")


def text_filter(spark, sf_dir, tokens) -> DataFrame:
    return apply_cascade(docs(spark, sf_dir).select("doc_id", "text"), tokens, "text", "raw").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'that')")
def rf_contains(spark, sf_dir):
    return text_filter(spark, sf_dir, ["that"])


@query("SELECT count(*) FILTER (contains(text, 'that')) AS lower_hits, count(*) FILTER (contains(text, 'That')) AS upper_hits FROM documents")
def rf_case_sensitive(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count_if(F.col("text").contains("that")).alias("lower_hits"), F.count_if(F.col("text").contains("That")).alias("upper_hits"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL")
def rf_empty_token(spark, sf_dir):
    return text_filter(spark, sf_dir, [""])


@query(f"SELECT doc_id FROM documents WHERE contains(text, substr('{LONG_TOKEN}', 1, 16))")
def rf_clamp16(spark, sf_dir):
    return text_filter(spark, sf_dir, [clamp(LONG_TOKEN)])


@query("""SELECT n_nationkey, unnest(list_concat([n_name], CASE WHEN length(n_name) > 4 THEN list_transform(range(1, length(n_name) - 2), lambda i: substr(n_name, i, 4)) ELSE [] END)) AS token FROM nation""")
def rf_decompose(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(decompose_column(F.col("n_name"))).alias("token"))


@query("SELECT n_nationkey, CAST(CASE WHEN length(n_name) > 4 THEN length(n_name) - 2 ELSE 1 END AS BIGINT) AS filters FROM nation")
def rf_decompose_counts(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(decompose_column(F.col("n_name"))).cast("bigint").alias("filters"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'that') AND contains(text, 'with') AND contains(text, 'tion')")
def rf_cascade_and(spark, sf_dir):
    return text_filter(spark, sf_dir, [*PAIR, "tion"])


@query("""SELECT CAST(sum(CASE WHEN contains(text, 'that') THEN 1 + CASE WHEN contains(text, 'with') THEN 1 + CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END) AS BIGINT) AS total_matches FROM documents""")
def rf_total_matches(spark, sf_dir):
    return stats(docs(spark, sf_dir), [*PAIR, "tion"], F.lit(True), "text").select("total_matches")


@query("SELECT doc_id FROM documents")
def rf_empty_schedule(spark, sf_dir):
    return text_filter(spark, sf_dir, [])


@query("SELECT count(*) AS n, count(*) FILTER (contains(text, 'that')) AS that_hits, count(*) FILTER (contains(text, 'with')) AS with_hits, count(*) FILTER (contains(text, 'License')) AS license_hits FROM documents")
def rf_passthrough_rates(spark, sf_dir):
    tokens = ["that", "with", "License"]
    patterns = hit_patterns(docs(spark, sf_dir), [RawFilter(t, i) for i, t in enumerate(tokens)], "text")
    n = sum(patterns.values())
    return spark.createDataFrame([(n, *[round(n * joint_rate(patterns, (i,))) for i in range(3)])], "n bigint, " + ", ".join(f"{t.lower()}_hits bigint" for t in tokens))


@query("""WITH t AS (SELECT * FROM (VALUES ('that'), ('with'), ('tion')) AS v(token))
SELECT a.token AS first_token, b.token AS second_token, count(d.doc_id) AS joint_hits FROM t a JOIN t b ON a.token < b.token
LEFT JOIN documents d ON contains(d.text, a.token) AND contains(d.text, b.token) GROUP BY a.token, b.token""")
def rf_joint_rates(spark, sf_dir):
    tokens = ["that", "tion", "with"]
    patterns = hit_patterns(docs(spark, sf_dir), [RawFilter(t, i) for i, t in enumerate(tokens)], "text")
    n = sum(patterns.values())
    rows = [(tokens[i], tokens[j], round(n * joint_rate(patterns, (i, j)))) for i, j in ((0, 1), (0, 2), (1, 2))]
    return spark.createDataFrame(rows, "first_token string, second_token string, joint_hits bigint")


SCHEDULES_SQL = """WITH rf AS (SELECT * FROM (VALUES {values}) AS v(idx, source, token)),
s AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000),
n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM s),
h AS (SELECT rf.idx, rf.source, s.doc_id FROM rf JOIN s ON contains(s.text, rf.token)),
p1 AS (SELECT rf.idx, rf.source, length(rf.token) AS len, COUNT(h.doc_id) AS c
       FROM rf LEFT JOIN h ON rf.idx = h.idx GROUP BY rf.idx, rf.source, length(rf.token)),
p2 AS (SELECT a.idx AS i, b.idx AS j, COUNT(*) AS c FROM h a
       JOIN h b ON a.doc_id = b.doc_id AND a.idx < b.idx AND a.source <> b.source GROUP BY a.idx, b.idx),
sched AS (
  SELECT 1 AS size, idx AS i, CAST(-1 AS INT) AS j, 8.0E0 * len + 2000.0E0 * (c / n) AS cost FROM p1 CROSS JOIN n
  UNION ALL
  SELECT 2, a.idx, b.idx, 8.0E0 * a.len + 8.0E0 * b.len * (a.c / n) + 2000.0E0 * (COALESCE(p2.c, 0) / n)
  FROM p1 a JOIN p1 b ON a.idx < b.idx AND a.source <> b.source
       LEFT JOIN p2 ON p2.i = a.idx AND p2.j = b.idx CROSS JOIN n)
""".format(values=", ".join(f"({i}, {f.source}, '{f.token}')" for i, f in enumerate(decompose(TERMS))))


def planned(spark, sf_dir):
    """All schedules for TERMS with costs, from the driver-side planner."""
    from .plans.planner import Schedule, enumerate_schedules, hit_patterns, schedule_cost

    head = sample_head(docs(spark, sf_dir).select("doc_id", "text"), 1000, "doc_id")
    filters = decompose(TERMS)
    patterns = hit_patterns(head, filters, "text")
    valid, _ = enumerate_schedules(filters, empty=False)
    return [Schedule(c, schedule_cost(filters, c, patterns, PARSE_COST)) for c in valid]


def schedule_rows(spark, schedules) -> DataFrame:
    rows = [(len(s.indexes), s.indexes[0], s.indexes[1] if len(s.indexes) > 1 else -1, round(s.cost, 6)) for s in schedules]
    return spark.createDataFrame(rows, "size int, i int, j int, cost double")


@query(SCHEDULES_SQL + "SELECT CAST(size AS INT) AS size, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM sched")
def schedule_enumerate(spark, sf_dir):
    return schedule_rows(spark, planned(spark, sf_dir)).select("size", "i", "j")


@query(SCHEDULES_SQL + "SELECT CAST(size AS INT) AS size, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(cost, 6) AS cost FROM sched")
def schedule_costs(spark, sf_dir):
    return schedule_rows(spark, planned(spark, sf_dir))


@query(SCHEDULES_SQL + "SELECT CAST(size AS INT) AS size, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(cost, 6) AS cost FROM sched ORDER BY cost, size, i, j LIMIT 1")
def schedule_best(spark, sf_dir):
    best = min(planned(spark, sf_dir), key=lambda s: (s.cost, len(s.indexes), s.indexes))
    return schedule_rows(spark, [best])


def pair_query() -> JsonQuery:
    q = JsonQuery()
    for token in PAIR:
        q.add_string_filter("text", contains(token))
    return q


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'that') AND contains(text, 'with')")
def raw_filter_then_parse(spark, sf_dir):
    q = pair_query().add_projection("doc_id", "int").add_projection("meta.source", alias="source")
    return search(raw_documents(spark, sf_dir), q).select("doc_id", "source")


@query("SELECT count(*) AS matches FROM documents WHERE contains(text, 'thatin') AND contains(text, 'ononst')")
def calibrate_then_search(spark, sf_dir):
    q = JsonQuery()
    for t in TERMS:
        q.add_string_filter("text", contains(t))
    found, _ = calibrated_search(raw_documents(spark, sf_dir), q, parse_cost=PARSE_COST)
    return found.agg(F.count("*").alias("matches"))


STATS_SQL = """SELECT count(*) AS records,
CAST(sum(CASE WHEN contains(text, 'that') THEN 1 + CASE WHEN contains(text, 'with') THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS total_matches,
count(*) FILTER (contains(text, 'that') AND contains(text, 'with')) AS rf_passed,
count(*) FILTER (contains(text, 'that') AND contains(text, 'with') AND contains(text, 'that ') AND contains(text, 'with ')) AS callback_passed FROM documents"""


def pair_stats(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    return stats(docs(spark, sf_dir), PAIR, text.contains("that ") & text.contains("with "), "text")


@query(f"""SELECT *, CASE WHEN rf_passed > 0 THEN callback_passed / rf_passed ELSE 0.0 END AS fraction_passed_correct,
CASE WHEN rf_passed > 0 THEN 1.0::DOUBLE - callback_passed / rf_passed ELSE 0.0 END AS fraction_passed_incorrect,
CAST(0 AS BIGINT) AS bytes_seeked_forward, CAST(0 AS BIGINT) AS bytes_seeked_backward FROM ({STATS_SQL})""")
def search_stats(spark, sf_dir):
    return pair_stats(spark, sf_dir)


@query(f"""SELECT *, CASE WHEN rf_passed > 0 THEN callback_passed / rf_passed ELSE 0.0 END AS fraction_passed_correct,
CASE WHEN rf_passed > 0 THEN 1.0::DOUBLE - callback_passed / rf_passed ELSE 0.0 END AS fraction_passed_incorrect,
CAST(0 AS BIGINT) AS bytes_seeked_forward, CAST(0 AS BIGINT) AS bytes_seeked_backward FROM ({STATS_SQL})""")
def search_stats_parsed(spark, sf_dir):
    q = JsonQuery().add_string_filter("text", contains("that ")).add_string_filter("text", contains("with "))
    return search_stats_of(raw_documents(spark, sf_dir), q, PAIR)


@query(f"""WITH s AS ({STATS_SQL}), f AS (SELECT *, CASE WHEN rf_passed > 0 THEN callback_passed / rf_passed ELSE 0.0 END AS a, CASE WHEN rf_passed > 0 THEN 1.0::DOUBLE - callback_passed / rf_passed ELSE 0.0 END AS b FROM s)
SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7])::INT AS line_no, unnest(['Records scanned: ' || records, 'Prefix token hits: ' || total_matches, 'Raw-filter survivors: ' || rf_passed,
'Exact matches: ' || callback_passed, 'Bytes skipped forward: 0', 'Bytes skipped backward: 0', 'Share of survivors correct: ' || format('{{:.6f}}', a), 'Share of survivors wrong: ' || format('{{:.6f}}', b)]) AS line FROM f""")
def stats_report_lines(spark, sf_dir):
    return stats_report(pair_stats(spark, sf_dir))


QUERIES["stats_report"] = QUERIES.pop("stats_report_lines")
ORACLE["stats_report"] = ORACLE.pop("stats_report_lines")


def json_docs(spark, sf_dir, build) -> DataFrame:
    q = JsonQuery().add_projection("doc_id", "int")
    build(q)
    return search(raw_documents(spark, sf_dir), q)


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def json_string_filter(spark, sf_dir):
    return json_docs(spark, sf_dir, lambda q: q.add_string_filter("text", contains("License"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def json_string_eq(spark, sf_dir):
    return json_docs(spark, sf_dir, lambda q: q.add_string_filter("meta.lang", equals("fr"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) % 7 = 3 AND contains(text, 'tion')")
def json_string_udf(spark, sf_dir):
    def build(q):
        @F.pandas_udf(T.BooleanType())
        def odd_length(s):
            return s.str.len() % 7 == 3

        q.add_string_filter("text", contains("tion")).add_string_filter("text", custom(odd_length))

    return json_docs(spark, sf_dir, build).select("doc_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT > 95")
def json_int_filter(spark, sf_dir):
    return search(props(spark, sf_dir), JsonQuery().add_integer_filter("k", lambda k: k > 95), ['"k"'], mode="raw").select("event_id")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT BETWEEN 10 AND 20")
def json_int_range(spark, sf_dir):
    q = JsonQuery().add_integer_filter("k", lambda k: k >= 10).add_integer_filter("k", lambda k: k <= 20).add_projection("k", "int")
    return execute(props(spark, sf_dir), q).select("event_id", "k")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def json_bool_filter(spark, sf_dir):
    return execute(raw_labels(spark, sf_dir), JsonQuery().add_boolean_filter("good").add_projection("doc_id", "int")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def json_nested_path(spark, sf_dir):
    return json_docs(spark, sf_dir, lambda q: q.add_string_filter("meta.lang", equals("en")).add_string_filter("meta.source", equals("src1"))).select("doc_id")


@query("SELECT doc_id, source AS meta_source, length(text) AS n FROM documents")
def json_project(spark, sf_dir):
    out = json_docs(spark, sf_dir, lambda q: q.add_projection("meta.source").add_projection("text"))
    return out.select("doc_id", "meta_source", F.length("text").cast("bigint").alias("n"))


@query("SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def json_path_exists(spark, sf_dir):
    return execute(raw_labels(spark, sf_dir), JsonQuery().add_exists("quality").add_projection("doc_id", "int")).select("doc_id")


@query("SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality >= 0")
def json_missing_field(spark, sf_dir):
    q = JsonQuery().add_integer_filter("quality", lambda v: v >= 0).add_projection("quality", "int").add_projection("doc_id", "int")
    return execute(raw_labels(spark, sf_dir), q).select("doc_id", "quality")


@query("SELECT count(*) AS parsed FROM events WHERE json_extract(props, '$.k')::BIGINT >= 0")
def json_parse_error(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.explode(split_records(F.col("text"))).alias("value"))
    mixed = props(spark, sf_dir).select("value").unionAll(lines)
    return execute(mixed, JsonQuery().add_integer_filter("k", lambda k: k >= 0)).agg(F.count("*").alias("parsed"))


@query("SELECT event_id FROM events WHERE false")
def json_empty_query(spark, sf_dir):
    return execute(props(spark, sf_dir), JsonQuery()).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'that') AND doc_id % 3 = 1 AND lang = 'en'")
def json_conjunction(spark, sf_dir):
    def build(q):
        q.add_string_filter("text", contains("that")).add_integer_filter("doc_id", lambda v: v % 3 == 1).add_string_filter("meta.lang", equals("en"))

    return json_docs(spark, sf_dir, build).select("doc_id")


@query("SELECT event_id, event_id % 100 AS k FROM events WHERE event_id % 100 > 50")
def json_duplicate_key(spark, sf_dir):
    key = F.col("event_id") % 100
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k":'), key, F.lit(',"k":'), key + 1000, F.lit("}")).alias("value"))
    q = JsonQuery().add_integer_filter("k", lambda k: k > 50).add_projection("k", "int")
    return execute(raw, q, strategy="path").select("event_id", "k")


@query("SELECT count(*) AS with_filters, count(*) AS parser_only FROM documents WHERE contains(text, 'that') AND contains(text, 'with')")
def equivalence_rf_vs_full(spark, sf_dir):
    raw = raw_documents(spark, sf_dir)
    a = search(raw, pair_query()).select(F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = search(raw, pair_query(), raw_filter=False).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionAll(b).agg(F.count_if(F.col("a") == 1).alias("with_filters"), F.count_if(F.col("b") == 1).alias("parser_only"))


def bitmaps(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).groupBy(F.bitmap_bucket_number("doc_id").alias("bucket"))


@query("SELECT doc_id // 32768 + CASE WHEN doc_id % 32768 = 0 THEN 0 ELSE 1 END AS bucket, count(DISTINCT doc_id) FILTER (contains(text, 'that')) AS set_bits FROM documents GROUP BY 1")
def bitmap_set_count(spark, sf_dir):
    return bitmaps(spark, sf_dir).agg(set_count(bitmap_of(F.col("doc_id"), F.col("text").contains("that"))).alias("set_bits"))


@query("SELECT doc_id // 32768 + CASE WHEN doc_id % 32768 = 0 THEN 0 ELSE 1 END AS bucket, count(DISTINCT doc_id) FILTER (contains(text, 'that') AND contains(text, 'with')) AS joint_bits FROM documents GROUP BY 1")
def bitmap_joint(spark, sf_dir):
    text = F.col("text")
    return bitmaps(spark, sf_dir).agg(bitmap_joint_count(F.col("doc_id"), text.contains("that"), text.contains("with")).alias("joint_bits"))


@query("SELECT doc_id, CAST((doc_id >> 3) & 1 AS INT) AS bit FROM documents")
def bitmap_getbit(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", get_bit(F.col("doc_id"), 3).cast("int").alias("bit"))


def _lane(pattern: str, name: str) -> None:
    w = len(pattern)

    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", lane_count(F.col("text"), pattern).alias("lanes"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, CAST(len(list_filter(range(1, 33, {w}), lambda i: substr(text, i, {w}) = '{pattern}')) AS INT) AS lanes FROM documents"


for _pattern in ("t", "th", "that"):
    _lane(_pattern, f"lane_count_{len(_pattern)}")


@query("SELECT count(*) AS matches FROM documents WHERE contains(text, 'that') AND contains(text, 'with')")
def demo_count(spark, sf_dir):
    return search(raw_documents(spark, sf_dir), pair_query()).agg(F.count("*").alias("matches"))


@query("SELECT doc_id FROM documents WHERE (contains(text, 'that') AND contains(text, 'with')) OR contains(text, 'License')")
def rf_disjunction(spark, sf_dir):
    keep = any_cascade(F.col("text"), [PAIR, ["License"]], "raw")
    return docs(spark, sf_dir).filter(keep).select("doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated search for two terms in serialised documents, with a projection."""
    q = pair_query().add_projection("doc_id", "int").add_projection("meta.lang", alias="lang")
    raw = raw_documents(spark, sf_dir)
    plan = calibrate(raw, q.literals(), parse_cost=PARSE_COST)
    return search(raw, q, plan.tokens).select("doc_id", "lang")
