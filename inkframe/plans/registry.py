"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(frame: DataFrame, digits: int = 6, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers as long; other numbers rounded for output, but for those that the query has ``rounded``."""
    columns = []
    for name, kind in frame.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float") and name not in rounded:
            c = F.round(c.cast("double"), digits)
        columns.append(c.alias(name))
    return frame.select(*columns)


def query(sql: str | None = None, digits: int = 6, rounded: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` is the same query for another engine.

    ``digits`` is chosen so that no exact quotient ends in a five one digit later.
    Columns in ``rounded`` are left as the function gives them.
    """

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(f(prepare(spark), folder), digits, rounded)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add
