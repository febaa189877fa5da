"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from gridsmith.plans import pipelines, problems, reference, registry, values

DATA = "/root/testdata/sf0.001"
MODULES = [problems, registry]
REGISTERED = (reference, pipelines, values)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
PAIRS = [(n, m) for m in MODULES for n in m.ORACLES]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v if isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.parametrize("name,module", PAIRS, ids=[n for n, _ in PAIRS])
def test_same_rows(spark, db, name, module):
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = db.sql(module.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.ORACLES])
def test_runs(spark, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    assert module.QUERIES[name](spark, DATA).collect()
