"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as driver
from anchorkit import catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name, driver.queries()[name], driver.oracle_sql().get(name)) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
