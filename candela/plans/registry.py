"""Named queries over the test tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.plans.tables import Tables
from candela.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its DuckDB counterpart."""
    if name in QUERIES:
        raise ValueError(f"query {name} exists already")

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(prepare(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rd(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round every double column of a result."""
    def at(c: str) -> int:
        return digits.get(c, 6) if isinstance(digits, dict) else digits
    return df.select(*[rd(c, at(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def Rs(names: str, digits: int = 6) -> str:
    """``R(a) AS a, R(b) AS b`` for a list of column names."""
    return ", ".join(f"{R(n, digits)} AS {n}" for n in names.split())
