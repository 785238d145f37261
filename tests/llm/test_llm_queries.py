import glob
import os

import pytest

from pitchweave.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ours, theirs = QUERIES[name](spark, data).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(tuple, ours[cols].astype(str).values)) == sorted(map(tuple, theirs[cols].astype(str).values))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
