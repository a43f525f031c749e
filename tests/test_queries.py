"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidelog.plans import queries as engine

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, db, name):
    df = engine.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in engine.ORACLE_SQL:
        assert got
        return
    rel = db.sql(engine.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert sorted(([plain(row[i]) for i in order] for row in rel.fetchall()), key=repr) == got
