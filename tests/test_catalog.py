"""Registered queries against their SQL on the smallest tables; skipped where the tables or DuckDB are not there."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    order = sorted(found.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == order
    rows = relation.select(*[f'"{c}"' for c in order]).fetchall()
    ours = [tuple(plain(v) for v in r) for r in found.select(*order).collect()]
    assert sorted(ours, key=repr) == sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:2] == ["case_id", "segment_id"]
