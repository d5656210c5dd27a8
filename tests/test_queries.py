"""Every registered query against its SQL on the small tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, decimal.Decimal) or (isinstance(value, int) and not isinstance(value, bool)):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(type(v)), v) for v in row])


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, sf, duck, name):
    result = entry_point.queries()[name](spark, sf)
    columns = sorted(result.columns)
    got = in_order([plain(r[c]) for c in columns] for r in result.collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == in_order([plain(r[i]) for i in places] for r in cursor.fetchall())


def test_flagship(spark):
    assert [r.weekday for r in entry_point.entry(spark).collect()][0] == "Monday"


def test_row_counts_of_the_review_rules(spark):
    """Counts that two engines agreed on for the lines of the 1,000-document table."""
    from reviewloom.operators import cleaning
    from reviewloom.plans import derived
    folder = "/root/testdata/sf0.01"
    lines = derived.reviews(spark, folder)
    assert lines.count() == 9344 and lines.filter("rating IS NOT NULL").count() == 8548
    ruled = cleaning.apply_rules(lines, derived.AS_OF)
    assert ruled.count() == 2665
    assert cleaning.keep_first(ruled, ["site", "content"], ["ingest_seq"]).count() == 2288
