"""Comparison of a Spark query with its SQL in DuckDB over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(rows, order):
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(found, key=lambda z: tuple((x is None, str(x)) for x in z))


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    ours = rows_of(df.collect(), [df.columns.index(c) for c in columns])
    theirs = rows_of(result.fetchall(), [names.index(c) for c in columns])
    assert len(ours) == len(theirs)
    assert ours == theirs
