"""Runs a query and its SQL on the same tables and says where they differ."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np


def plain(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value) + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(value)


def bag(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


def sql(folder: str, statement: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'").fetchall()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'").fetchall()
    return con.execute(statement).df()


def differing(ours, folder: str, statement: str) -> str:
    theirs = sql(folder, statement)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = bag(ours), bag(theirs)
    return "" if a == b else f"only ours {list((a - b).items())[:3]}, only SQL {list((b - a).items())[:3]}"
