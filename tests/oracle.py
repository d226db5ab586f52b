"""Compare a query's rows with those of its SQL in DuckDB."""

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.10g}")
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    have_rows = [tuple(r) for r in df.collect()]
    have_names, have = bag(df.columns, have_rows)
    want_names, want = bag(names, want_rows)
    if have_names != want_names:
        return f"columns {have_names} != {want_names}"
    if have != want:
        extra, missing = have - want, want - have
        return f"{sum(have.values())} vs {sum(want.values())} rows; extra {list(extra)[:3]}; missing {list(missing)[:3]}"
    for i, name in enumerate(df.columns):
        j = names.index(name)
        a = {kind(r[i]) for r in have_rows if r[i] is not None}
        b = {kind(r[j]) for r in want_rows if r[j] is not None}
        if a != b:
            return f"types of {name}: {a} != {b}"
    return None
