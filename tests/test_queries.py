"""Every query of the engine's own operators against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from rasterloom.operators import queries as general
from rasterloom.plans import imagery_queries as imagery
from rasterloom.plans import scene_queries as scenes

MODULES = (general, imagery, scenes)
SQL = {k: v for m in MODULES for k, v in m.oracle_sql().items()}
RUN = {k: v for m in MODULES for k, v in m.queries().items()}


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    df = RUN[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert RUN[name](spark, data).count() >= 0
