"""Every query with SQL, held against DuckDB on the smallest tables."""

import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from newsloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"
SQL = catalogue.ORACLES  # the training-data operators' queries are tested with them


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    got = driver.queries()[name](spark, SMALL)
    expected = oracle.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    rows = Counter(tuple(plain(r[n]) for n in names) for r in got.collect())
    assert rows == Counter(tuple(plain(v) for v in r) for r in expected.fetchall())
    assert rows or name in ("missing_hours", "manifest_duplicates")


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())
