"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import compare, connect

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
ORACLES = entry.oracle_sql()


def test_registry():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) > 160


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    ok, message = compare(entry.queries()[name](spark, SMALL), ORACLES[name], con)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and "target" in df.columns
