"""Rows of a query against rows of its SQL in DuckDB."""

import datetime
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 12) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x if x is None or isinstance(x, (int, str, datetime.date)) else float(x) if hasattr(x, "as_tuple") else x


def differences(spark, sf, name, run, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    df = run(spark, sf)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    order = sorted(df.columns)
    mine = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    theirs = Counter(tuple(value(r[i]) for i in at) for r in rel.fetchall())
    if mine != theirs:
        return f"{name}: {sum(mine.values())} and {sum(theirs.values())} rows; {order}; only mine {list((mine - theirs).items())[:3]}; only theirs {list((theirs - mine).items())[:3]}"
    return "" if mine else f"{name}: no rows" if name not in MAY_BE_EMPTY else ""


MAY_BE_EMPTY = {"flt_8_invalid_candidates"}
