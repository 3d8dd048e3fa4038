"""Runs queries in Spark and their SQL in DuckDB and compares the rows.

``python tests/check_oracle.py [sf_dir] [key ...]`` prints one line per key.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _ordered(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows as sorted tuples of comparable text."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    table = [tuple(f"{type(row[i]).__name__}:{row[i]!r}" for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table)


def differences(spark, connection, sf_dir: str, query, sql: str) -> list[str]:
    """What differs between both results; empty if they are the same."""
    df = query(spark, sf_dir)
    mine = _ordered(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    theirs = _ordered(names, cursor.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} and {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        return [f"{len(mine[1])} and {len(theirs[1])} rows"]
    pairs = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return [f"{a}\n     and {b}" for a, b in pairs[:3]] + ([f"{len(pairs)} rows"] if pairs else [])


def main() -> None:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry

    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = session(), database(sf_dir)
    queries, texts = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in sys.argv[2:] or queries:
        start = time.time()
        try:
            if key in texts:
                found = differences(spark, connection, sf_dir, queries[key], texts[key])
                state = "equal" if not found else "DIFFERENT " + "\n  ".join(found)
            else:
                found, state = [], f"{len(queries[key](spark, sf_dir).collect())} rows, no SQL"
        except Exception as error:  # one failing key must not hide the others
            found, state = [error], f"ERROR {str(error)[:600]}"
        failed += bool(found)
        print(f"{key}: {state} ({time.time() - start:.2f} s)", flush=True)
    print(f"{failed} failed", flush=True)


if __name__ == "__main__":
    main()
