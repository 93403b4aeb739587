"""Compare a query with its SQL counterpart, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def kind(name: str) -> str:
    """Common name of a column type."""
    name = name.lower()
    return {
        "long": "bigint", "integer": "int", "varchar": "string", "int64": "bigint", "int32": "int", "utf8": "string", "bool": "boolean",
    }.get(name, name)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and rows; an empty list if there are none."""
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: kind(str(d[1])) for d in result.description}
    want = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for column, t in df.dtypes:
        if kind(t) != types[column]:
            problems.append(f"type of {column}: {t} against {types[column]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} against {len(b)}")
    if not a:
        problems.append("no rows")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"{len(only_a)} rows differ: {only_a[:2]} against {only_b[:2]}")
    return problems
