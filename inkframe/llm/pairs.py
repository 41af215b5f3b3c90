"""Comparing the members of many groups, each pair of blocks in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_blocks(frame: DataFrame, group: str, size: Column, member: str, block: int, volume: Column | None = None, block_bytes: int = 1) -> DataFrame:
    """Copy each row to the pairs of blocks in which its group's members meet.

    A group of up to ``block`` members is one block. A larger one is cut by a
    hash into about size / block blocks; columns __a <= __b name a pair of
    blocks. Every two members of a group meet in exactly one pair. ``volume``
    is the bytes of a group; with it, blocks have about ``block_bytes`` at most.
    """
    blocks = F.ceil(size / F.lit(block)).cast("int")
    if volume is not None:
        blocks = F.greatest(blocks, F.ceil(volume / F.lit(block_bytes)).cast("int"))
    return (
        frame.withColumn("__k", blocks)
        .withColumn("__mine", F.pmod(F.xxhash64(F.lit("block"), F.col(member)), F.col("__k")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
        .withColumn("__a", F.least("__mine", "__other"))
        .withColumn("__b", F.greatest("__mine", "__other"))
        .drop("__k", "__other")
    )


class Forest:
    """Union-find over the nodes that one task meets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x] = top
            x = above
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
Compare = Callable[[pa.RecordBatch, np.ndarray, bool, Forest, list[tuple[int, int]]], None]


def one_batch(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows of ``held``; offsets of bytes have 64 bits, as 32 end at 2 GiB and would leave several batches."""
    schema = pa.schema([f.with_type(pa.large_binary()) if pa.types.is_binary(f.type) else f for f in held[0].schema])
    made = pa.Table.from_batches(held).cast(schema).combine_chunks().to_batches()
    if len(made) != 1:
        raise RuntimeError(f"a pair of blocks came out as {len(made)} batches")
    return made[0]


def compare_groups(dealt: DataFrame, group: str, columns: list[str], compare: Compare) -> DataFrame:
    """Run ``compare(rows, block of each row, same block, forest, edges)`` on each pair of blocks.

    Rows are shuffled by group and pair, sorted, and streamed, so a task holds
    one pair of blocks at a time. ``compare`` appends edges that join two trees
    of the forest; a task thus emits fewer edges than it has nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            one = one_batch(held)
            edges: list[tuple[int, int]] = []
            if one.num_rows > 1:
                same = one.column("__a")[0].as_py() == one.column("__b")[0].as_py()
                compare(one, one.column("__mine").to_numpy(), same, forest, edges)
            held.clear()
            if edges:
                u, v = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=EDGE)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (group, "__a", "__b")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, low].tolist())
                if key != last:
                    yield from close()
                    last = key
                held.append(batch.slice(low, high - low))
        yield from close()

    placed = dealt.select(group, "__a", "__b", "__mine", *columns).repartition(group, "__a", "__b")
    return placed.sortWithinPartitions(group, "__a", "__b").mapInArrow(run, "u long, v long")
