"""Every registered query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from arbelo.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 6):.6f}" if math.isfinite(float(v)) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
