import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Compares a query with its SQL: same columns, same rows in any order."""

    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    def compare(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        theirs = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
        assert mine == theirs

    return compare
