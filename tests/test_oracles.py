import glob
import math
import os

import duckdb
import pytest
from conftest import SF

from lexloom.plans import catalog

SLOW: set[str] = set()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same(a):
    return sorted((tuple(map(cell, r)) for r in a), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_same_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert same(df.select(*columns).collect()) == same([tuple(r[i] for i in order) for r in want.fetchall()])
