"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def normal(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [tuple(_value(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(tidy, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    return normal([d[0] for d in found.description], found.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    left, right = spark_rows(df), duck_rows(con, sql)
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for mine, theirs in zip(left[1], right[1]):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{str(mine)[:400]} != {str(theirs)[:400]}"
    return None
