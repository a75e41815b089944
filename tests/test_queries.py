"""Every registered core query against its SQL on the smallest tables."""

import math
import os

import pytest

from opsframe import queries as Q
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, views, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    want = views.sql(Q.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(plain(r[i])) for i in at) for r in want.fetchall())
