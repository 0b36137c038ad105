"""Every query that SQL can say gives the rows of its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from nearby.plans import catalog
from tools.compare import TABLES, rows

#: Queries whose SQL is slow or whose compile time is long; the comparison tool runs them too.
SAMPLE = sorted(n for n in catalog.QUERIES if n in catalog.ORACLES)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, small, db, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
