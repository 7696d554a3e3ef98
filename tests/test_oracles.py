"""Every query of the library against its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from corpuscope import registry
from corpuscope.plans import load_all

SF = "/root/testdata/sf0.001"
load_all()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert ours == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in found.fetchall())
