"""Run a query and its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def duck(sql: str, data: str = DATA) -> list[tuple]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(data, t)}.parquet')")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(plain(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in got.fetchall()), key=repr)


def spark_rows(df) -> list[tuple]:
    return sorted((tuple(plain(r[n]) for n in sorted(df.columns)) for r in df.collect()), key=repr)


def plain(x):
    return round(x, 9) if isinstance(x, float) else x
