"""Compares a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """Empty if both results have the same columns and the same rows, bit for bit."""
    found = duck(sf_dir).sql(sql)
    columns = [name for name in found.columns]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(columns)}"]
    ours = multiset(df.columns, [tuple(r) for r in df.collect()])
    theirs = multiset(columns, found.fetchall())
    out = []
    if sum(ours.values()) != sum(theirs.values()):
        out.append(f"{sum(ours.values())} rows instead of {sum(theirs.values())}")
    missing, extra = theirs - ours, ours - theirs
    if missing or extra:
        out.append(f"missing {list(missing)[:2]} extra {list(extra)[:2]}")
    types = {name: str(kind) for name, kind in zip(columns, found.types)}
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if same.get(kind) != types[name]:
            out.append(f"column {name} is {kind}, SQL has {types[name]}")
    return out
