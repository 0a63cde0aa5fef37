"""Run registered queries against their SQL and compare the values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def compare(spark, con, folder, fn, sql):
    """A description of the difference, or None, with row count and seconds."""
    start = time.perf_counter()
    names, got = spark_rows(fn(spark, folder))
    seconds = time.perf_counter() - start
    if sql is None:
        return (None if got else "no rows"), len(got), seconds
    other, want = duck_rows(con, sql)
    if names != other:
        return f"columns {names} != {other}", len(got), seconds
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), seconds
    if not got:
        return "no rows", 0, seconds
    for g, w in zip(got, want):
        if g != w:
            return f"{g!r:.600} != {w!r:.600}", len(got), seconds
        if [type(x) for x in g] != [type(x) for x in w] and None not in g:
            return f"types {g!r:.300} {w!r:.300}", len(got), seconds
    return None, len(got), seconds
