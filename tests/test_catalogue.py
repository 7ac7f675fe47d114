"""Every catalogue query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from camtrail import catalogue, catalogue_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        found.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{files}'")
    return found


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue_sql.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    want = tables.sql(catalogue_sql.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_branch_counts(spark):
    """Counts of the adapter's outcomes at the default threshold."""
    rows = catalogue.QUERIES["combined_gate"](spark, SF_DIR)
    assert rows.count() == 485
    levels = {r["class_name"]: r["n"] for r in catalogue.QUERIES["review_level"](spark, SF_DIR).collect()}
    assert levels == {"good": 118, "warn": 181, "low": 186}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
