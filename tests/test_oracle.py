"""Every registered query against its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tripkit import plans

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


# The same types under their names in either engine.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module", params=FOLDERS, ids=lambda f: f.rsplit("/", 1)[-1])
def tables(request):
    folder = request.param
    if not Path(folder).exists():
        pytest.skip(f"{folder} is not here")
    database = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    yield folder, database
    database.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, name):
    folder, database = tables
    ours = QUERIES[name](spark, folder)
    expected = database.sql(ORACLES[name])
    assert {c: TYPES[t] for c, t in ours.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    theirs = database.execute(ORACLES[name])
    their_columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(their_columns)
    got = rows_by_name(ours.columns, [tuple(row) for row in ours.collect()])
    wanted = rows_by_name(their_columns, theirs.fetchall())
    assert got == wanted
    assert sum(got.values()) > 0


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["l_suppkey", "avg_price"]
    assert result.count() > 0
