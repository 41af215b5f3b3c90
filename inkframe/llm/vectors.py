"""What the operators on vectors share: rows that take part, and their matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is neither null nor empty and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def common_width(rows: DataFrame, vector: str) -> int | None:
    """The most frequent length of a vector, the least of equally frequent ones; None for an empty table."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if found is None else int(found["d"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths, a row per list."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = held.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(held), -1) if len(held) else flat.reshape(0, 1)


def scaled(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def largest(rows: DataFrame, vector: str) -> float:
    """The largest magnitude of a component; 0 for an empty table."""
    size = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return float(rows.agg(F.max(size)).first()[0] or 0.0)
