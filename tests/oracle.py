"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, name, query, sql, d) -> str:
    """'' where both have the same columns and rows, else what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows(want_cols, cur.fetchall())
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} / {sorted(want_cols)}"
    if got != want:
        return f"{name}: {sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:4]}; only SQL {list((want - got).items())[:4]}"
    return ""
