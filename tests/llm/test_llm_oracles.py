"""The training-data queries against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF

from lexloom.llm.queries import ORACLES, QUERIES


def cell(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted((tuple(map(cell, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=repr) and got
