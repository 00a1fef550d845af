"""Compare a Spark result with DuckDB on the same parquet files, as whole bags of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder):
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return tuple(_plain(item) for item in value) if isinstance(value, list) else value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def assert_same(df, connection, sql):
    cursor = connection.execute(sql)
    names = [item[0] for item in cursor.description]
    expected = bag(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    actual = bag(df.columns, [tuple(row) for row in df.collect()])
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(expected.values())} rows expected, {sum(actual.values())} found; "
        f"missing {list(missing.items())[:3]}, extra {list(extra.items())[:3]}"
    )
