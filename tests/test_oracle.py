"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from salescope.plans.oracle import oracle
from salescope.plans.queries import registry
from tests.check_oracle import database, differences

QUERIES, SQL = registry(), oracle()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("key", SQL)
def test_result_equals_sql(spark, connection, sf_dir, key):
    assert differences(spark, connection, sf_dir, QUERIES[key], SQL[key]) == []


@pytest.mark.parametrize("key", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "key",
    ["sales_summary_view", "sales_summary_monthly", "validate_constraints", "load_orders", "describe"],
)
def test_result_is_the_same_when_tables_are_too_large_to_broadcast(spark, connection, sf_dir, key):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert differences(spark, connection, sf_dir, QUERIES[key], SQL[key]) == []
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_entry_names_every_query(spark):
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
