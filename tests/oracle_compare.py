"""Runs registered queries in Spark and their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return None if math.isnan(f) else round(f, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    mine, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs, ocols = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{cols}\n  spark {a}\n  duck  {b}"
    return None
