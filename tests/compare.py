"""Run registered queries in Spark and their SQL in DuckDB, and compare.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=str)


def differences(df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows; else what differs."""
    found = con.execute(sql)
    expected_types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    expected = found.fetchall()
    actual_types = dict(df.dtypes)
    if set(actual_types) != set(expected_types):
        return f"columns {sorted(set(actual_types) ^ set(expected_types))}"
    if actual_types != expected_types:
        return "types " + str({c: (actual_types[c], expected_types[c]) for c in actual_types if actual_types[c] != expected_types[c]})
    actual = [tuple(row) for row in df.collect()]
    if len(actual) != len(expected):
        return f"row count {len(actual)} != {len(expected)}"
    left = _rows(df.columns, actual)
    right = _rows(list(expected_types), expected)
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        return f"{len(differing)} of {len(left)} rows differ, first {differing[0]}"
    if not left:
        return "no rows"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    runs, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(runs):
        started = time.time()
        try:
            df = runs[name](spark, sf_dir)
            result = differences(df, con, checks[name]) if name in checks else f"unchecked, {df.count()} rows"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += result is not None
        print(f"{name:32s} {time.time() - started:6.2f}s {result or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
