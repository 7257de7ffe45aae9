"""Compare a Spark result with DuckDB's over the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    columns, rows = oracle(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = normal(df.columns, [tuple(r) for r in df.collect()]), normal(columns, rows)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only Spark: {[x for x in a if x not in set(b)][:3]}; only SQL: {[x for x in b if x not in set(a)][:3]}"
