import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def _plain(v):
    import decimal

    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL as the driver does: columns by name, rows as a multiset."""

    def check(f, sql):
        df = f(spark, sf)
        cols = sorted(df.columns)
        mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert mine == theirs

    return check
