"""Every query of the core against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else float(f"{v:.9g}")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    if name not in SQL:
        assert df.limit(1).count() == 1
        return
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    ran = duck.execute(SQL[name])
    theirs = [c[0] for c in ran.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in ran.fetchall()), key=str)
    assert got == want
