"""Rows of a query and of its DuckDB SQL, ready to compare."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, **frames):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if t not in frames and os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    for t, f in frames.items():
        con.register(t, f)
    return con


def rows(frame_rows, columns, order):
    at = [columns.index(c) for c in order]
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(plain(r[i]) for i in at) for r in frame_rows), key=repr)


def same(df, con, sql):
    got, want = df.collect(), con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert rows(got, df.columns, order) == rows(want.fetchall(), want.columns, order)
