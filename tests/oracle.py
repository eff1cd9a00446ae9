"""Runs queries and their SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in directory.iterdir():
        target = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{target}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    """Both sides as bags of rows with columns in the order of their names."""
    names = sorted(df.columns)
    mine = Counter(tuple(_value(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    theirs = Counter(tuple(_value(r[i]) for i in order) for r in found.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    return sum(mine.values())
