import pytest

from rawscan import queries

TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\n\n", "\na", "a\n\nb\n", ".", "..", "a.", "a..", ".a", "a.b", "a\r\n", "é.\n", "\n.", ".\n"]


@pytest.fixture(scope="module")
def odd_texts(tmp_path_factory):
    import pyarrow
    from pyarrow import parquet

    at = tmp_path_factory.mktemp("odd")
    rows = pyarrow.table({"doc_id": pyarrow.array(range(len(TEXTS)), pyarrow.int64()), "text": pyarrow.array(TEXTS, pyarrow.string())})
    parquet.write_table(rows, at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("name", ["scan_empty_records", "scan_records", "scan_records_custom_delim"])
def test_odd_texts_match_sql(spark, compare, odd_texts, name, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got, want = compare(queries.QUERIES[name](spark, odd_texts), queries.ORACLE[name], odd_texts)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want and len(got) == len(TEXTS)
