"""Runs a query beside its DuckDB SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def order(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, want = rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    want = sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (g, w)
