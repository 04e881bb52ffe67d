"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def kind(name: str) -> str:
    name = name.upper()
    if any(k in name for k in ("INT", "LONG")) and "INTERVAL" not in name:
        return "HUGEINT" if "HUGE" in name else "INT"
    if any(k in name for k in ("DOUBLE", "FLOAT")):
        return "FLOAT"
    return {"VARCHAR": "STRING"}.get(name, name)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    theirs = rows_of(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    for field in df.schema.fields:
        a, b = kind(field.dataType.simpleString()), types[field.name]
        if a != b and not (a.startswith(("ARRAY", "STRUCT")) or b.endswith("]")):
            return f"type of {field.name}: {a} / {b}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"\n  spark {a}\n  sql   {b}"
    return None
