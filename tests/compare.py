"""Rows of a query against those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, db, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want, strict=True) if g != w][:3] == [w for g, w in zip(got, want, strict=True) if g != w][:3]
