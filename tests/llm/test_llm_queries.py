"""The training-data queries against their SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from rasterloom.llm import queries

SQL, RUN = queries.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    df = RUN[name](spark, data)
    cols = sorted(df.columns)
    rel = duck.execute(SQL[name])
    at = [[x[0] for x in rel.description].index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert RUN[name](spark, data).count() > 0


def test_the_trees_have_a_query(spark):
    from rasterloom.llm import queries as q

    d = "/root/testdata/sf0.001"
    names = list(q.queries())
    assert names.index("p9_method") < names.index("p9_found")
    rows = q.queries()["p9_method"](spark, d).collect()
    assert len(rows) == q.table(spark, d, "documents").filter("doc_id is not null").count()
