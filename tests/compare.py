"""Running registered queries beside their SQL twins."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def differs(spark, con, sf, name, query, sql) -> str | None:
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{name}: {len(got[1])} and {len(want[1])} rows; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return None
