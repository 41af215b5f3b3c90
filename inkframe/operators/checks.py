"""Integrity checks: each returns the offending rows, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class IntegrityError(ValueError):
    """A check found offending rows."""


def require(offending: DataFrame, message: str, shown: int = 10) -> None:
    """Raise with the first few offending rows if there are any."""
    rows = offending.limit(shown).collect()
    if rows:
        raise IntegrityError(f"{message}: {[r.asDict() for r in rows]}")


def duplicates(frame: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(frame: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return frame.join(known.select(*on).distinct(), on, "left_anti")


def shared_members(frame: DataFrame, member: list[str], owner: str) -> DataFrame:
    """Members that belong to more than one owner: component exclusivity, split disjointness."""
    return frame.groupBy(*member).agg(F.count_distinct(owner).alias("n")).filter("n > 1")


def size_conflicts(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Pages whose known sizes differ; 0 means unknown."""
    known = lambda f, p: f.select(*on, *(F.nullif(F.col(c), F.lit(0)).alias(f"{p}_{c}") for c in ("width", "height")))
    joined = known(first, "a").join(known(second, "b"), on)
    return joined.filter((F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height")))


def bad_vectors(frame: DataFrame, vec: str, width: int) -> DataFrame:
    """Vectors of another length or with null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.filter(~F.coalesce((F.size(vec) == width) & finite, F.lit(False)))


def without_positive(edges: DataFrame, query: list[str], label: str) -> DataFrame:
    """Queries none of whose candidates is right."""
    return edges.groupBy(*query).agg(F.bool_or(label).alias("any")).filter("NOT any").select(*query)


def order_mismatch(first: DataFrame, second: DataFrame, on: list[str], ids: str) -> DataFrame:
    """Keys whose ordered id lists differ between two tables."""
    a, b = first.select(*on, F.col(ids).alias("a")), second.select(*on, F.col(ids).alias("b"))
    return a.join(b, on, "full").filter(~F.col("a").eqNullSafe(F.col("b")))


def box_mismatch(a: Column, b: Column, tolerance: float) -> Column:
    """Whether any component differs by more than an absolute tolerance."""
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > tolerance), lambda d: F.coalesce(d, F.lit(True)))


def error_report(errors: DataFrame, kind: str, order: str, detail: str, examples: int = 100) -> DataFrame:
    """Count per kind of error and its first examples."""
    w = Window.partitionBy(kind).orderBy(order)
    ranked = errors.withColumn("__r", F.row_number().over(w))
    kept = F.collect_list(F.when(F.col("__r") <= examples, F.struct("__r", detail)))
    return ranked.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(kept), lambda s: s[detail]).alias("examples"))


def unavailable(configured: DataFrame, available: DataFrame, on: list[str]) -> DataFrame:
    """Configured entries without a source; they are reported, not fatal."""
    return configured.join(available.select(*on).distinct(), on, "left_anti")


def passes(value: Column, threshold: float) -> Column:
    """A confidence gate: null fails."""
    return F.coalesce(value, F.lit(-1.0)) >= threshold


def out_of_range(parameters: DataFrame, name: str, value: str, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Parameters outside their limits (ends included; None is no limit), with a message. A null value is out of range."""
    message = F.lit(None).cast("string")
    for known, (low, high) in limits.items():
        good = F.lit(True)
        if low is not None:
            good = good & (F.col(value) >= low)
        if high is not None:
            good = good & (F.col(value) <= high)
        text = f"{known} must be between {low} and {high}" if None not in (low, high) else f"{known} must be at least {low}" if high is None else f"{known} must be at most {high}"
        message = F.when((F.col(name) == known) & ~F.coalesce(good, F.lit(False)), text).otherwise(message)
    return parameters.withColumn("message", message).filter("message IS NOT NULL")


def regressions(found: DataFrame, expected: DataFrame, on: list[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """Keys whose recomputed value differs from the stored one (column ``expected``), or is missing."""
    joined = expected.join(found, on, "left")
    return joined.filter(F.coalesce(F.abs(F.col(value) - F.col("expected")) > tolerance, F.lit(True)))
