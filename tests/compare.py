"""Runs queries beside their SQL on DuckDB and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(cols, data):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(show(r[i]) for i in order) for r in data)


def same(df, con, sql):
    """None if equal, else what differs."""
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, got.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in b][:3]} and {[x for x in b if x not in a][:3]}"
    return None
