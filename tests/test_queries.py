"""Each query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import rounds, specs, trees  # noqa: F401 - they register their queries
from quillon.plans.queries import QUERIES, SQL
from tools.oracle_check import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(normal(r[c]) for c in cols)) for r in df.collect())
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(normal(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
