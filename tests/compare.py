"""Rows of a Spark query and of its SQL, in a common form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5)
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(c, sql):
    cursor = c.execute(sql)
    got = [d[0] for d in cursor.description]
    names = sorted(got)
    at = [got.index(n) for n in names]
    return names, sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cursor.fetchall()), key=repr)
