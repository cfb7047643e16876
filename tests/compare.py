"""Compare a Spark result with the DuckDB result of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TESTDATA = "/root/testdata"


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(TESTDATA, sf, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(row[name] for name in names) for row in df.collect()])


def oracle_rows(connection, sql: str):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    places = [columns.index(name) for name in sorted(columns)]
    return sorted(columns), _sorted([tuple(row[i] for i in places) for row in result.fetchall()])


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v) if not _nan(v) else (True, "", 0) for v in row))


def _nan(value) -> bool:
    return isinstance(value, float) and math.isnan(value)
