"""Run registered queries against their check SQL in DuckDB."""

from __future__ import annotations

import math
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def difference(spark, con, build, check: str, folder: str) -> str | None:
    """None when both sides agree on names, types and rows."""
    frame = build(spark, folder)
    left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.sql(check)
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} != {sorted(relation.columns)}"
    ours = {f.name: f.dataType.simpleString() for f in frame.schema}
    theirs = {c: KINDS.get(str(ty), str(ty)) for c, ty in zip(relation.columns, relation.types)}
    if ours != theirs:
        return f"types {[(c, ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]]}"
    right = rows_of(relation.columns, relation.fetchall())
    if left == right:
        return None
    only_left, only_right = [r for r in left if r not in right][:2] if len(left) < 20000 else left[:2], [r for r in right if r not in left][:2] if len(left) < 20000 else right[:2]
    return f"{len(left)} rows vs {len(right)}; spark {only_left} check {only_right}"


def report(spark, queries, checks, folder: str, names=None):
    con = connect(folder)
    for name in names or queries:
        start = time.perf_counter()
        try:
            if name in checks:
                problem = difference(spark, con, queries[name], checks[name], folder)
            else:
                problem = f"(no check) {queries[name](spark, folder).count()} rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        yield name, problem, time.perf_counter() - start
