"""Every registered query with checking SQL agrees with it at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from factspark.sources.tables import GIVEN

from .conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return "D" + str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def table(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"adjudicate_hot"}))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
