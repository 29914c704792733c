"""Every registered query against its SQL in DuckDB on the smallest tables, all rows compared."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def base(sf_dir):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, base, name):
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if name not in ORACLES:
        assert got
        return
    answer = base.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows_of(columns, answer.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
