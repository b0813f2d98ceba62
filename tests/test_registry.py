"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as driver
from compare import SF_DIR, differences, engine
from tablegauge.registry.queries import registered
from tablegauge.registry.sql import oracles

QUERIES, SQL = registered(), oracles()


@pytest.fixture(scope="module")
def duck():
    return engine(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(spark, duck, QUERIES[name], SQL[name]) == []


def test_entry_point_has_every_query():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["dimension", "pass_rate_pct", "total_checks", "failed", "warnings"]
    assert df.count() == 4
