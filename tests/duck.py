"""Holds a query against its SQL on the test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    if hasattr(x, "as_tuple"):
        return round(float(x), 7)
    return x


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def oracle(sql: str, sf: str):
    con = duckdb.connect()
    for path in (DATA / sf).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def check(df, sql: str, sf: str) -> None:
    columns, rows = oracle(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    assert _sorted(df.columns, df.collect()) == _sorted(columns, rows)
