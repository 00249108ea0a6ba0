"""Every query against its SQL oracle in DuckDB, at the smallest size."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import basics, exports, layers, reads, records, shapes  # noqa: F401  (register their queries)
from tessera.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(map(norm, r)) for r in df.select(*cols).collect()]
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    assert sorted(d[0] for d in cur.description) == cols
    order = [[d[0] for d in cur.description].index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
