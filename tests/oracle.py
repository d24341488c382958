"""Runs a query in Spark and its SQL in DuckDB and compares the rows as multisets."""

import collections
import datetime
import decimal
import glob
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, fn, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = collections.Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    if got == want:
        return ""
    return f"rows {sum(got.values())} != {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
