"""Run a registered query and its DuckDB oracle; compare like the driver.

Columns are matched by name, rows compared order-insensitively with exact
values (floats, dates and decimals as Python values).
"""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, exact: bool):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if exact else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list):
        return tuple(_norm(x, exact) for x in v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(sdf, con, sql: str, exact: bool = True) -> str | None:
    """None when equal, else a short description of the first difference."""
    cols = sdf.columns
    srows = [tuple(_norm(v, exact) for v in r) for r in sdf.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    if sorted(cols) != sorted(dcols):
        return f"columns {cols} vs {dcols}"
    order = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i], exact) for i in order) for r in rel.fetchall()]
    if len(srows) != len(drows):
        return f"rows {len(srows)} vs {len(drows)}"
    for a, b in zip(sorted(srows, key=_key), sorted(drows, key=_key)):
        if a != b:
            return f"row differs: {a} vs {b}"
    return None
