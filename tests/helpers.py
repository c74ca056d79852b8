"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def database() -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(spark, name: str, query, sql: str) -> None:
    df = query(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = database().execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names), name
    want = rows(names, cur.fetchall())
    assert len(got) == len(want), name
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(a, b)), (name, a, b)
