"""Queries register themselves with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero; NaN becomes null."""
    return F.when(~F.isnan(x), F.round(x, digits) + F.lit(0.0))


def s6(x: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite(({x})::DOUBLE) THEN round(({x})::DOUBLE, {digits}) + 0.0 END"
