"""Runs registered queries against their SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, float):
        return (1, f"{round(x, 6) + 0.0:.6f}")
    return (1, str(x))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, d, query, sql):
    """None if equal, else what differs."""
    df = query(spark, d)
    rel = connect(d).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(rel.columns, rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None
