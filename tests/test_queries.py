"""Every query with SQL against DuckDB on the smallest tables; every other one for its rows."""

import glob
import os

import pandas as pd
import pytest

from pitchweave.plans import registry

duckdb = pytest.importorskip("duckdb")
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)

    def plain(df):
        out = df[sorted(df.columns)].copy()
        for c in out:
            number = pd.to_numeric(out[c], errors="coerce") if out[c].map(lambda v: v is None or isinstance(v, (int, float))).all() else None
            out[c] = number.astype(float).round(4).fillna(-1e18).astype(str) if number is not None else out[c].fillna("").astype(str)
        return sorted(map(tuple, out.values))

    assert plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, data, name):
    same(Q[name](spark, data).toPandas(), db.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, data, name):
    df = Q[name](spark, data)
    assert df.columns and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(SQL) <= set(Q)
