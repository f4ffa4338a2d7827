"""Every core query against its SQL on the smallest tables, and on awkward and empty ones without a crash."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from foliospark import catalog
from tests.conftest import DATA
from tests.fixtures import awkward_rows, write_tables

FOLDER = DATA / "sf0.001"
PAGE_QUERIES = [q for q in catalog.QUERIES if q not in ("event_windows", "pricing_summary")]


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if value == value else None
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    return str(value.replace(tzinfo=None)) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(frame.columns)
    found = sorted(str(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    relation = tables.execute(catalog.SQL[name])
    names = [d[0] for d in relation.description]
    wanted = sorted(str(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in relation.fetchall())
    assert sorted(names) == columns
    assert found == wanted


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("awkward"), awkward_rows(), clashes=True)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_awkward_rows(spark, awkward, name):
    catalog.QUERIES[name](spark, awkward).collect()


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_empty_tables(spark, empty, name):
    rows = catalog.QUERIES[name](spark, empty).collect()
    assert len(rows) <= 1
