"""Rows of a query against rows of its SQL, as sorted text with columns by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def tidy(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


def of_sql(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    done = base.execute(sql)
    columns = [c[0] for c in done.description]
    return sorted(columns), tidy(columns, done.fetchall())


def of_spark(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), tidy(frame.columns, frame.collect())
