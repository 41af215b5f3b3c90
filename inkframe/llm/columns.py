"""Columns that an operator only passes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passing(documents: DataFrame, needed: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``documents`` whose columns other than ``needed`` have names of no meaning meanwhile.

    So no name of theirs can clash with one that the operator makes. ``run``
    returns all columns that it gets; names and order are those of before.
    """
    plain = {c: c if c in needed else f"passed{i}" for i, c in enumerate(documents.columns)}
    found = run(documents.select(*(F.col(f"`{c}`").alias(n) for c, n in plain.items())))
    return found.select(*(F.col(n).alias(c) for c, n in plain.items()))
