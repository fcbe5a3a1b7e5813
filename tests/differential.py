"""Runs a query on Spark and its SQL on DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (float, int)) and not hasattr(v, "as_tuple"):
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(plain, v)) + "]"
        return str(v)
    return f"{float(v):.6g}" if not math.isnan(float(v)) else "nan"


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
