"""Every registered query against its SQL, and the facts known of the inputs."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from docflow.plans import oracle, queries as registered

QUERIES = registered.all_queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def database(tables):
    connection = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def as_text(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(as_text, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(as_text(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, tables, database, name):
    frame = QUERIES[name](spark, tables)
    result = database.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert sorted_rows(frame.columns, frame.collect()) == sorted_rows(columns, result.fetchall())


def test_entry_gives_a_row_per_document(spark):
    assert entry_points.entry(spark).count() == 200


@pytest.mark.parametrize(
    "name",
    ["document_status", "missing_page_status", "generated_pages", "active_pages", "dropped_pages", "failed_documents",
     "failures", "request_batch_timing"],
)
def test_status_is_made_without_reading_texts(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("text:" in line for line in scans)
