"""Running queries and their SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got_columns, got = df.columns, rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_columns = [c[0] for c in cur.description]
    want = rows(want_columns, cur.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} and {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    types = [(a, b) for a, b in zip(got[:1000], want[:1000]) if tuple(map(type, a)) != tuple(map(type, b))]
    if types:
        return f"types: {types[0]}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(diff)} rows differ: {diff[0]}" if diff else None
