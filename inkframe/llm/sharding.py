"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
#: Sub-ranges of a shard that are numbered side by side. The table of their
#: sizes has at most (shards x SLICES) rows, which bounds what is broadcast.
SLICES = 512


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard; ``number`` is unique in its level."""

    number: int
    weight: float
    children: tuple["Node", ...] = ()


def tree(shards: int, weights: dict[int, float] | None = None) -> tuple[Node, ...]:
    """Regions of a tree over shards 0..shards-1, filled rack by rack.

    An inner node weighs as much as its shards together. Capacity that is added
    at a region boundary is a subtree of its own, so no weight elsewhere changes.
    """
    leaves = [Node(i, (weights or {}).get(i, 1.0)) for i in range(shards)]

    def level(nodes: list[Node], size: int) -> list[Node]:
        groups = [nodes[i : i + size] for i in range(0, len(nodes), size)]
        return [Node(i, sum(n.weight for n in g), tuple(g)) for i, g in enumerate(groups)]

    return tuple(level(level(leaves, SHARDS_PER_RACK), RACKS_PER_REGION))


def _draw(key: Column, level: str, nodes: tuple[Node, ...]) -> Column:
    """The node whose exponential draw, at the rate of its weight, is least.

    Raising one weight moves keys only into that node: no other draw changes.
    """
    two53 = float(1 << 53)
    draws = []
    for node in nodes:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(node.number), key), 11)
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(two53)
        draws.append(F.struct((-F.log(uniform) / F.lit(float(node.weight))).alias("draw"), F.lit(node.number).alias("node")))
    return F.array_min(F.array(*draws))["node"]


def _descend(key: Column, nodes: tuple[Node, ...], levels: tuple[str, ...]) -> Column:
    if len(nodes) == 1:
        only = nodes[0]
        return F.lit(only.number) if not only.children else _descend(key, only.children, levels[1:])
    chosen = _draw(key, levels[0], nodes)
    if not nodes[0].children:
        return chosen
    below = None
    for node in nodes:
        inner = _descend(key, node.children, levels[1:])
        below = F.when(chosen == node.number, inner) if below is None else below.when(chosen == node.number, inner)
    return below


def shard_of(key: Column, regions: tuple[Node, ...]) -> Column:
    """Shard of a key: a weighted draw among regions, then racks, then shards.

    The result depends on the key and the tree alone. A null key is a key of
    its own and always goes to one shard.
    """
    return _descend(key.cast("long"), regions, ("region", "rack", "shard")).cast("int")


def number_within(frame: DataFrame, shard: str, key: str, slot: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Gapless numbers from 0 in each shard without a task that holds a whole shard.

    Rows are dealt to ``SLICES`` hash slices per shard by key and ``ties``, so
    that rows of one key are spread, too, numbered inside the slice, and moved
    by the sizes of the slices before it.
    """
    part = "__slice"
    sliced = frame.withColumn(part, F.pmod(F.xxhash64(F.lit("slice"), F.col(key), *(F.col(c) for c in ties)), F.lit(SLICES)).cast("int"))
    sizes = sliced.groupBy(shard, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, part).orderBy(*(F.col(c) for c in (key, *ties)))
    numbered = sliced.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        numbered.join(F.broadcast(starts), [shard, part])
        .withColumn(slot, (F.col("__row") + F.col("__start")).cast("long"))
        .drop("__row", "__start", part)
    )


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Put documents into shards; law ``key``: doc_id and the shard count decide.

    Null texts have size 1 and the checksum of the empty string; a null doc_id
    goes to one fixed shard; rows that repeat a doc_id share its shard and get
    slots of their own; an empty table gives an empty result. Columns other
    than doc_id and text are not read.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = rows.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree(shards)).alias("shard"),
        shard_of(F.col("doc_id"), tree(shards + 1)).alias("grown_shard"),
    )
    numbered = number_within(placed, "shard", "doc_id", "slot", ties=("text_crc32", "size"))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
