"""Runs a query's SQL in DuckDB over the Parquet tables and compares rows without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda t: tuple((x is not None, str(x)) for x in t))


def compare(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    cur = connection(sf_dir).execute(sql)
    expected = rows_of([c[0] for c in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1], strict=True):
        assert a == b
