"""How the catalog pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in ENTRIES:
            raise ValueError(f"two queries are named {name}")
        ENTRIES[name] = Entry(fn, sql, tuple(covers.split()))
        return fn
    return register


def r(column, digits: int = 9) -> Column:
    """Round a double for comparison: the two engines sum in different orders."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
