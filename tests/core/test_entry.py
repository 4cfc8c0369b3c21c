"""Every query with SQL agrees with it at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from causalgraph import queries as core

SF = "/root/testdata/sf0.001"
CORE = sorted(core.SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    return c


def norm(v):
    return None if v is None or v != v else float(f"{float(v):.8g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert want and any(v is not None for row in want for v in row), "no rows prove nothing"
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 25
