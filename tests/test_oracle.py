"""Every registered query against its SQL form on DuckDB."""

import pytest
from conftest import DATA
from oracle import connect, difference

from catalog import QUERIES, SQL

CON = connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert difference(CON, SQL[name], QUERIES[name](spark, DATA)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
