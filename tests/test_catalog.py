"""Every query with a DuckDB twin gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from finloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert df.columns
        return
    rel = con.sql(catalog.ORACLES[name])
    names = rel.columns
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    left = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got)
    right = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in rel.fetchall())
    assert left == right


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
