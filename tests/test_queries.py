"""Registered queries against their SQL twins on the smallest data set."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from workloads import registry

SF = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
CHECKED = sorted(registry.QUERIES)

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want

def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
