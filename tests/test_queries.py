"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from emberframe.plans import queries_ensemble, queries_models, queries_tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (queries_tables, queries_models, queries_ensemble)
QUERIES = {n: q for p in PLANS for n, q in p.QUERIES.items()}
SQL = {n: s for p in PLANS for n, s in p.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    return str(v) if v is not None else ""


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
