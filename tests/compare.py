"""Runs registered queries beside their SQL on the same tables and tells where rows differ."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def difference(spark, con, name, f, sql, sf_dir) -> str | None:
    df = f(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = rows_of(names, cur.fetchall())
    if ours == theirs:
        return None
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a, key=repr)[:2]}; only SQL {sorted(b, key=repr)[:2]}"
