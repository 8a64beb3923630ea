"""Compares a query with its SQL as the driver does: sorted columns, rows in any order."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def assert_same(spark, query, sql: str, sf: str = SF) -> None:
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = connect(sf).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
