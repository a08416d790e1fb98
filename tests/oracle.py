"""Runs a query and its SQL side by side."""

import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


def same(spark, con, sf, f, sql):
    df = f(spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    names = [d[0] for d in rel.description]
    assert cols == sorted(names)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    order = [names.index(c) for c in cols]
    theirs = sorted(str([plain(r[i]) for i in order]) for r in rel.fetchall())
    assert ours == theirs
