"""Registered queries: a name, a function (spark, folder) -> DataFrame, and where one exists the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its survey id and short name."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} exists twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rounded(name: str, digits: int = 6, of: Column | None = None) -> Column:
    """A computed double, rounded on both sides of a comparison."""
    return F.round(F.col(name) if of is None else of, digits).alias(name)


def finished(result: DataFrame, *cached: DataFrame) -> DataFrame:
    """A parameter-sized result computed now, after which the cached rows are let go."""
    from centrum.operators.ordering import settle

    out = settle(result)
    for df in cached:
        df.unpersist()
    return out


def load_all() -> None:
    """Import the modules that register queries."""
    from centrum.queries import assign, fitting, history, inputs, models, scoring, trees, unrolled  # noqa: F401
