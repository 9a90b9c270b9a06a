"""Every query against its SQL on the smallest given tables."""

from pathlib import Path

import pytest
from oracle import connect, differences, type_differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) is None
        assert type_differences(df, con, sql) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_keys_are_read_without_texts(spark):
    from catalog.queries import QUERIES

    plan = QUERIES["grid_keys"](spark, "/root/testdata/sf0.001")
    scans = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    assert scans and not any("text:" in x for x in scans)
