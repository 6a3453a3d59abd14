"""Every registered query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from corvane.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = tables.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.project(", ".join(columns)).fetchall())
