"""Compare a query with its SQL on the small tables."""

from __future__ import annotations

import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 9)) if abs(x) < 1e6 else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def same(df, con, sql: str) -> str | None:
    """None if columns and rows are equal, else what differs first."""
    got = df.collect()
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    a = sorted(tuple(cell(r[c]) for c in columns) for r in got)
    at = [names.index(c) for c in columns]
    b = sorted(tuple(cell(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:2]}, only there {sorted(set(b) - set(a))[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, as {columns} {bad[0]}" if bad else None
