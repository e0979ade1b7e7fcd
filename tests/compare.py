"""A Spark result and a DuckDB result as comparable rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=2")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is not None, str(x)) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=_key)


def same(df, con, sql):
    """None, or what differs first."""
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    b = rows_of([d[0] for d in found.description], found.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    return next((f"{x} {y}" for x, y in zip(a[1], b[1], strict=True) if x != y), None)
