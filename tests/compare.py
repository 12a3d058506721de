"""Order-free comparison of a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if abs(v) < 1e-9 else f"{v:.6g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(norm(r[k]) for k in order) for r in rows)


def same(df, con, sql):
    got = table(df.columns, df.collect())
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert got == want
