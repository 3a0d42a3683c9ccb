"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from skirmish.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", [k for k, (_, q) in QUERIES.items() if q])
def test_query(spark, duck, name):
    make, sql = QUERIES[name]
    df = make(spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    want = ordered([tuple(plain(r[i]) for i in at) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-6, nan_ok=True) if all(isinstance(x, (int, float)) and x is not None for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", ["bootstrap_ci", "permutation_importance"])
def test_rows(spark, name):
    assert QUERIES[name][0](spark, FOLDER).count() > 0
