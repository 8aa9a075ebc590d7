"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillrank import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_all_but_two_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"vbmw_partition", "cursor_counters"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["vbmw_partition", "cursor_counters"])
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
