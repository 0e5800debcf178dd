"""Every query of the catalogue against its SQL on another engine."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from driftline.sources.given_tables import TABLES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def _canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    check = registry.oracle_sql().get(name)
    if check is None:
        assert rows
        return
    result = duck.sql(check)
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert _canonical(rows) == _canonical(expected)


def test_entry(spark):
    assert registry.entry(spark).count() == 3


def test_every_check_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
