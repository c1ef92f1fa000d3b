"""Each query over the smallest tables gives the rows of its SQL."""

import os

import duckdb
import pytest

from morphlake.plans.driver_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return int(v) if isinstance(v, bool) or hasattr(v, "item") else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in pdf.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in ("part", "orders", "events", "documents", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    assert name in ORACLES
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(database.execute(ORACLES[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.HERE)
