"""Runs queries against their SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(clean(r[i]) for i in order) for r in values)


def compare(spark, con, query, sql: str, d: str):
    df = query(spark, d)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    other = rows([c[0] for c in found.description], found.fetchall())
    assert mine[0] == other[0], (mine[0], other[0])
    assert len(mine[1]) == len(other[1]), (len(mine[1]), len(other[1]))
    different = [(a, b) for a, b in zip(mine[1], other[1], strict=True) if a != b]
    assert not different, different[:3]
