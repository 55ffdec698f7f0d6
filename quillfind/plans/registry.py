"""Where queries are registered: name -> function, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def seconds(c: str) -> Column:
    return F.unix_seconds(c).alias(c)


def listed(v: Column, digits: int | None = None) -> Column:
    """An array as text, the same in both engines."""
    items = F.transform(v, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + 0.0) if digits is not None else x.cast("string"))
    return F.array_join(items, ",")


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a small table of constants: columns as name type, ..."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    names = [c.split()[0] for c in columns.split(", ")]
    cast = ", ".join(f"{n}::{k} AS {n}" for n, k in (c.split() for c in columns.split(", ")))
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(names)})"
