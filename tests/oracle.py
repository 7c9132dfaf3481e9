"""Compare a catalogue query with its SQL twin on DuckDB."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.12g}" if value != 0 else "0"
    if isinstance(value, int):
        return f"{float(value):.12g}" if abs(value) < 10**11 else str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(canonical(v)) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in value.items()) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(str(canonical(r[i])) for i in order) for r in rows])


def spark_rows(df):
    def plain(v):
        if hasattr(v, "asDict"):
            return v.asDict()
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return rows_of(df.columns, [[plain(v) for v in r] for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql):
    """None when equal, else a short description."""
    names_a, a = spark_rows(df)
    names_b, b = duck_rows(con, sql)
    if names_a != names_b:
        return f"columns {names_a} vs {names_b}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; {a[:1]} | {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None
