"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from salescope.llm.oracle import SQL
from salescope.llm.queries import QUERIES
from tests.check_oracle import differences


@pytest.mark.parametrize("key", SQL)
def test_result_equals_sql(spark, sf_dir, key):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert differences(spark, connection, sf_dir, QUERIES[key], SQL[key]) == []
