"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import math
from pathlib import Path


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{files}')")
    return con


def canon(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, dict):
        return tuple(map(canon, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(canon(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def sql_rows(con, sql):
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(canon(r[i]) for i in order) for r in out.fetchall()), key=repr)
