"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle_check import connect, differences

from timelens.plans.catalog import QUERIES
from timelens.plans.oracle import SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no given tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in SQL:
        assert df.count() > 0
        return
    assert differences(df, con, SQL[name])[1] is None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
