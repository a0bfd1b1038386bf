"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from shelfmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT:
        return "null"
    return f"{float(v):.6f}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = [c for c in got.columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"]
    for c in floats:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
