"""Compares registered queries with DuckDB, the way the driver does: columns by name, rows in any order."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    if mine != theirs:
        return f"{sum(mine.values())} rows and {sum(theirs.values())}; {list((mine - theirs).items())[:2]} against {list((theirs - mine).items())[:2]}"
    return ""
