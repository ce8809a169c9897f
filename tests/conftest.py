import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """compare(spark_df, sql, sf_dir): rows of both, sorted, as comparable lists."""
    import datetime

    import duckdb

    def clean(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    def run(df, sql, sf_dir):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            table = name.split(".")[0]
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = sorted((tuple(clean(r[i]) for i in order) for r in found.fetchall()), key=repr)
        assert sorted(df.columns) == sorted(names)
        got = sorted((tuple(clean(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
        return got, want

    return run
