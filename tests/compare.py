"""A Spark query beside the same in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connect(root: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, str | bytes | bool):
        return v
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, float | np.floating | decimal.Decimal):
        return None if v != v else round(float(v), 6)
    if isinstance(v, datetime.date):
        return str(v)
    return int(v) if isinstance(v, int | np.integer) else v


def same(spark, query, sql: str, root: str = DATA) -> None:
    df = query(spark, root)
    got = [tuple(r) for r in df.collect()]
    cur = connect(root).execute(sql)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    pick = lambda rs, ns: sorted((tuple(plain(r[ns.index(c)]) for c in cols) for r in rs), key=repr)
    assert pick(got, df.columns) == pick(want, names)
