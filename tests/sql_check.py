"""Compare a query with its SQL: the same rows in any order."""

import math
import os
from decimal import Decimal

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def text(v):
    if v is None:
        return "NULL"
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def assert_same(spark, con, sf_dir, query, oracle):
    df = query(spark, sf_dir)
    cur = con.execute(oracle)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
