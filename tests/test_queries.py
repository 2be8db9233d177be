"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the harness's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, list):
        return str([canon(y) for y in x])
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    rows = rel.fetchall() if hasattr(rel, "fetchall") else rel.execute().fetchall()
    want = sorted(tuple(canon(dict(zip(rel.columns, r, strict=True))[c]) for c in names) for r in rows)
    assert got == want
