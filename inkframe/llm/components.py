"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import Store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, store: Store, name: str, rounds: int = 60) -> DataFrame:
    """Label the ends of ``edges(u, v)`` with the least node that they reach.

    Returns (node, component) for every node of an edge, self-edges aside. Each
    round is written to the shared folder and only its row count and checksum
    come to the driver. Stars leave hubs with many neighbours; both joins are
    on keys whose other side is one row, so skewed keys can be split.
    """
    now = store.put(
        f"{name}-0",
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
    )
    seen = None
    for i in range(1, rounds + 1):
        now = store.put(f"{name}-{i}", _small_star(_large_star(now)))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(f"{name}-{i - 1}")
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components of {name} have not settled in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
