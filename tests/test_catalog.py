"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import catalog
from factloom.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "~" if x is None or x != x else (f"{x:.6f}" if isinstance(x, float) else str(x))
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, con, name):
    mine, other = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert canon(mine) == canon(other)
