"""Every registered query against its SQL form."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_over_bars_has_a_statement():
    assert set(SQL) <= set(QUERIES)
    assert all(name.startswith("op") or name == "pipeline" for name in set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    relation = duck.execute(SQL[name])
    columns = [d[0] for d in relation.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = rows_of(columns, relation.fetchall())
    found = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    assert len(found) == len(expected)
    different = [pair for pair in zip(found, expected, strict=True) if pair[0] != pair[1]]
    assert not different, different[:3]
