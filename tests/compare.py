"""Run a registered query and its SQL twin and compare columns and values."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    return repr(value) if not isinstance(value, bool) else str(value)


def frame(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def kinds(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def differences(spark, con, folder, name, work, sql) -> list[str]:
    df = work(spark, folder)
    mine = frame(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other = frame([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return [f"{name}: columns {mine[0]} / {other[0]}"]
    if len(mine[1]) != len(other[1]):
        return [f"{name}: rows {len(mine[1])} / {len(other[1])}"]
    if not mine[1]:
        return [f"{name}: no rows"]
    out = [f"{name}: {mine[0]}\n   spark {a}\n   sql   {b}" for a, b in zip(mine[1], other[1]) if a != b]
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    sql_types = kinds(con, sql)
    out += [f"{name}: type of {c} {t} / {sql_types[c]}" for c, t in df.dtypes if pairs.get(t) != sql_types[c]]
    return out[:3] + ([f"{name}: {len(out)} differences"] if len(out) > 3 else [])
