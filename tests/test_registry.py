"""Every registered query against its SQL oracle (DuckDB) on the smallest data,
as the driver does at sf0.01."""

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and "total_claims" in df.columns


def test_every_query_has_an_oracle():
    from caremart.plans.registry import oracle_sql, queries
    assert set(queries()) == set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")
def test_queries_match_oracle(spark, duck):
    from caremart.plans.registry import oracle_sql, queries
    bad = []
    for name, fn in queries().items():
        df = fn(spark, SF_SMALL)
        got = _bag(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(oracle_sql()[name])
        want = _bag([d[0] for d in cur.description], cur.fetchall())
        if got != want or sorted(df.columns) != sorted(d[0] for d in cur.description):
            bad.append(name)
    assert bad == []
