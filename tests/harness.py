"""Compares a query's rows with those of its SQL, column by column, whatever the order of rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both agree, else what differs first."""
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; only here {[r for r in got if r not in set(want)][:2]}, only there {[r for r in want if r not in set(got)][:2]}"
    return next((f"{a} against {b}" for a, b in zip(got, want, strict=True) if a != b), "")
