"""Runs a query beside its SQL on the same tables."""

import glob
import math
import os

import duckdb


def connection(d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in found), key=repr), [columns[i] for i in order]


def compare(spark, d, query, sql):
    df = query(spark, d)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connection(d)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows(names, cursor.fetchall())
    assert mine[1] == theirs[1]
    assert len(mine[0]) == len(theirs[0])
    assert mine[0] == theirs[0]
