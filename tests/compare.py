"""Rows of a Spark query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb


def shown(v) -> str:
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def bag(rows, columns) -> list[tuple[str, ...]]:
    return sorted(tuple(shown(r[c]) for c in columns) for r in rows)


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    assert bag(df.collect(), columns) == bag(want, columns)
