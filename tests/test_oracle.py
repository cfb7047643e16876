"""Every registered query against its SQL, at the smallest and the checked scale."""

import datetime
import decimal

import pytest

import __spark_entry__ as entry_module
import checks.queries
from tests.compare import TESTDATA, oracle, oracle_rows, spark_rows

# Queries of the corpus package are tested beside it.
QUERIES = {name: query for name, query in entry_module.queries().items() if name in checks.queries.QUERIES}
SQL = {name: sql for name, sql in entry_module.oracle_sql().items() if name in QUERIES}


def _plain(rows):
    def plain(value):
        if isinstance(value, decimal.Decimal):
            return float(value)
        if isinstance(value, datetime.datetime) and value.tzinfo:
            return value.replace(tzinfo=None)
        return value

    return [tuple(plain(value) for value in row) for row in rows]


TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name, sf):
    with oracle(sf) as connection:
        want_names, want = oracle_rows(connection, SQL[name])
        types = dict(row[:2] for row in connection.execute(f"DESCRIBE {SQL[name]}").fetchall())
    result = QUERIES[name](spark, f"{TESTDATA}/{sf}")
    assert {column: TYPES[kind] for column, kind in result.dtypes} == types
    names, got = spark_rows(result)
    assert names == want_names
    assert len(got) == len(want)
    assert _plain(got) == _plain(want)
    assert got


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
