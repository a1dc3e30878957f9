"""Spark results against DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{round(v, 3) + 0.0:.3f}"
    if isinstance(v, int):
        return f"{v}"
    if isinstance(v, datetime.datetime):
        return str(v) if v.time() != datetime.time() else str(v.date())
    if isinstance(v, datetime.date):
        return str(v)
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def differences(spark, con, sf_dir, query, sql):
    """What differs (empty if nothing)."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(got, df.columns), rows(want, names)
    # a number with a decimal may be whole on the other side
    norm = lambda t: tuple(f"{float(x):.3f}" if _number(x) else x for x in t)
    a, b = sorted(map(norm, a)), sorted(map(norm, b))
    if a == b:
        return ""
    off = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} and {len(b)} rows; {len(set(a) ^ set(b))} differ; {off}"


def _number(x):
    try:
        float(x)
        return True
    except ValueError:
        return False
