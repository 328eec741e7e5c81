"""Holds a query's rows against its SQL in DuckDB, whatever the order of rows and columns."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return f"{float(v):.9g}" if hasattr(v, "as_tuple") else str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def difference(spark, con, run, sql, sf_dir):
    """None if both give the same rows, else a short account."""
    got = run(spark, sf_dir)
    names = sorted(got.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in got.collect()]
    cur = con.execute(sql)
    own = [d[0] for d in cur.description]
    if sorted(own) != names:
        return f"columns {names} and {sorted(own)}"
    at = [own.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    a, b = Counter(rows), Counter(want)
    if a == b:
        return None
    return f"{len(rows)} rows and {len(want)}; only in the first: {list((a - b).items())[:2]}; only in the second: {list((b - a).items())[:2]}"[:900]
