import pytest

from rawscan import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, compare, name):
    got, want = compare(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)
    assert got == want


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
