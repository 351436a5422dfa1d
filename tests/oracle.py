"""Compares a query with its SQL twin over one set of tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connected(sf_dir: str = DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str = DATA) -> str:
    """'' if both give the same columns and rows."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows_of(names, found.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs))[:3]}; only SQL {list((theirs - ours))[:3]}"
