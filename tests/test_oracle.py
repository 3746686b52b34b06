"""Every core query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftline.plans import core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(name, spark, sf, duck):
    df = core.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    if name not in SQL:
        assert len(got) > 0
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(row[i] for i in at)) for row in r.fetchall())
