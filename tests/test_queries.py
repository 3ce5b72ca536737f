"""Registered queries against their SQL twins on the smallest tables.

A selection runs by default; BINDERY_ALL_QUERIES=1 runs every query."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from bindery.catalog import CATALOG

SF = "/root/testdata/sf0.001"
QUICK = ["a4_d8_d9_d10_paths", "b6_extract_csharp", "c5_make_preview", "d3_stem", "e1_upsert_lineitem", "e5_scan",
         "e8_reconcile_lineitem", "f7_scored_pairs", "g1_stats", "h1_registry_query", "i6_suggest_groups", "j3_debounce"]
RUN = sorted(entry.queries()) if os.environ.get("BINDERY_ALL_QUERIES") else QUICK


def cells(rows, cols):
    def cell(v):
        return round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([cell(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", RUN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    rows = df.collect()
    if sql:
        cur = duck.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert cells(rows, df.columns) == cells(cur.fetchall(), cols)


def test_every_query_has_a_twin():
    assert set(CATALOG) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
