"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of c or more are at a squared distance of 2 - 2c at
most. Rotated vectors are split into blocks of dimensions; if every block were
farther than its share of that budget, in proportion to its dimensions, the sum
would be over the budget. So each link is within budget in one block at least,
and the pairs within budget in any block hold all links.

Each block is range-joined twice: first between chunks of rows, whose balls in
the block are farther apart than its radius or not, then between the rows of
chunk pairs that are left in some block. What a block lets through is united in
the task and verified by the true cosine there, so no pair of rows is emitted:
a task gives counts, and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.ann import kmeans, unit
from inkframe.llm.components import components
from inkframe.llm.store import Store
from inkframe.llm.vectors import common_width, finite, matrix


@dataclass(frozen=True)
class Settings:
    """``cosine`` links. Vectors are split into ``blocks`` subspaces. A label's
    distinct vectors are dealt to the nearest of its cells, one for every
    ``chunk`` of them, ``most_cells`` at most; the cells' centres are fitted on
    at most ``sample`` vectors drawn by a hash, and only make chunks compact:
    no result depends on them. Cells beyond ``chunk`` rows are cut. ``salt``
    spreads a label's chunk pairs over so many keys."""

    cosine: float = 0.93
    blocks: int = 8
    chunk: int = 1024
    most_cells: int = 1024
    sample: int = 20_000
    rounds: int = 6
    salt: int = 16
    seed: int = 12


#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-9


@dataclass(frozen=True)
class Space:
    """A rotation, the bounds of its blocks, and centres of cells in the rotated space."""

    rotation: np.ndarray
    bounds: list[int]
    centres: np.ndarray
    budget: float

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def budgets(self) -> list[float]:
        """Each block's share of the squared distance, by its dimensions."""
        return [self.budget * (b - a) / self.bounds[-1] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def cells(self, x: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The nearest of the first ``allowed`` centres of each rotated row."""
        d = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        d[np.arange(len(self.centres)) >= allowed[:, None]] = np.inf
        return d.argmin(axis=1)

    def reach(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The distance of each row from its centre, a column per block."""
        return np.stack([np.sqrt((p**2).sum(axis=1)) for p in self.parts(x - self.centres[cell])], axis=1)

    def may_meet(self, cell: np.ndarray, ball: np.ndarray, other: np.ndarray, other_ball: np.ndarray) -> np.ndarray:
        """True where in some block two balls are within the block's radius."""
        apart = self.reach(self.centres[cell], other) - ball - other_ball
        return (np.maximum(apart, 0.0) ** 2 <= np.array(self.budgets()) + SLACK).any(axis=1)

    def candidates(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """True for pairs of rotated rows that are within budget in some block."""
        found = np.zeros((len(x), len(y)), bool)
        for a, b, most in zip(self.parts(x), self.parts(y), self.budgets(), strict=True):
            found |= (a**2).sum(axis=1)[:, None] + ((b**2).sum(axis=1) - 2 * a @ b.T) <= most + SLACK
        return found


def random_rotation(width: int, seed: int) -> np.ndarray:
    """An orthogonal matrix drawn evenly."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over edges i - j."""
    label = np.arange(n)
    while True:
        before = label
        low = np.minimum(label[i], label[j])
        label = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def linked(space: Space, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """True for pairs of unit rows with that cosine or more, by the blocks and then exactly."""
    near = space.candidates(x @ space.rotation, y @ space.rotation)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if len(rows):
        at = np.ix_(rows, columns)
        near[at] &= x[rows] @ y[columns].T >= cosine
    return near


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", s: Settings = Settings()) -> DataFrame:
    """key, n_links, component_id and kept, one row per vector.

    Vectors are compared only with vectors of an equal label. A null label, and
    a vector that is null, empty, zero, of null or non-finite components or of
    another length than the most common one, link with nothing: such a row has
    0 links, its own id as component and is kept. Equal vectors of a label link
    with each other and are compared once. Rows that repeat an id are vectors of
    their own, each with its own links. A row without an id is linked and
    counted, but names no component and is never kept. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "subspace")
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), values.alias("v"))
    takes_part = F.col("label").isNotNull() & finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    width = common_width(rows.filter(takes_part), "v")
    if width is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    takes_part = takes_part & (F.size("v") == width)
    alone = rows.filter(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    rows = rows.filter(takes_part)

    made = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = store.put("classes", made.withColumn("c", F.monotonically_increasing_id()))
    members = rows.join(classes.select("label", "v", "c"), ["label", "v"]).select("id", "c")
    sizes = store.put("groups", classes.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("g", F.monotonically_increasing_id()))
    largest = sizes.agg(F.max("size")).first()[0]

    draw = F.xxhash64(F.lit(s.seed), "c")
    chosen = classes.filter(F.pmod(draw, F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * s.sample / classes.count())).orderBy(draw).limit(s.sample).select("v").toArrow()
    width_each = min(s.blocks, width)
    bounds = np.linspace(0, width, width_each + 1).astype(int).tolist()
    rotation = random_rotation(width, s.seed)
    sample = unit(matrix(chosen.column("v"))) @ rotation if chosen.num_rows else np.zeros((1, width))
    cells = min(s.most_cells, math.ceil(largest / s.chunk))
    space = Space(rotation, bounds, kmeans(sample, cells, s.rounds, np.random.default_rng(s.seed)), 2 - 2 * s.cosine)
    sent = spark.sparkContext.broadcast(space)  # width x width and at most most_cells x width numbers
    chunk, most = s.chunk, len(space.centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v")))
                rotated = x @ space.rotation
                allowed = np.minimum(-(-batch.column("size").to_numpy() // chunk), most)
                cell = space.cells(rotated, allowed)
                reach = space.reach(rotated, cell)
                lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in (x, reach)]
                kept = [batch.column(c) for c in ("c", "g", "n")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(cell, pa.int32()), *lists], names=["c", "g", "n", "cell", "x", "reach"])

    schema = "c long, g long, n long, cell int, x array<double>, reach array<double>"
    placed = store.put("placed", classes.join(sizes, "label").select("c", "g", "n", "size", "v").mapInArrow(place, schema))
    cuts = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.chunk)).alias("cuts"))
    placed = placed.join(cuts, ["g", "cell"]).withColumn("cut", F.pmod(F.xxhash64(F.lit("cut"), "c"), F.col("cuts")).cast("int")).drop("cuts")
    balls = F.array(*(F.max(F.get("reach", F.lit(i))) for i in range(len(bounds) - 1))).alias("ball")
    chunks = store.put("chunks", placed.groupBy("g", "cell", "cut").agg(balls).withColumn("k", F.monotonically_increasing_id()))

    left = chunks.select("g", F.col("k").alias("a"), F.col("cell").alias("cell_a"), F.col("ball").alias("ball_a"), F.pmod(F.xxhash64("k"), F.lit(s.salt)).alias("salt"))
    right = chunks.select("g", F.col("k").alias("b"), F.col("cell").alias("cell_b"), F.col("ball").alias("ball_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.salt - 1).cast("long"))).alias("salt"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        for batch in batches:
            if batch.num_rows:
                at = {c: batch.column(c) for c in batch.schema.names}
                meets = space.may_meet(at["cell_a"].to_numpy(), matrix(at["ball_a"]), at["cell_b"].to_numpy(), matrix(at["ball_b"]))
                yield batch.select(["a", "b"]).filter(pa.array(meets))

    meetings = left.join(right, ["g", "salt"]).filter("a <= b").drop("g", "salt").mapInArrow(prune, "a long, b long")
    pairs = store.put("pairs", meetings.withColumn("p", F.monotonically_increasing_id()))
    of_chunk = placed.join(chunks.select("g", "cell", "cut", "k"), ["g", "cell", "cut"]).select("k", "c", "n", "x")
    first = of_chunk.join(pairs.select(F.col("a").alias("k"), "p", (F.col("a") == F.col("b")).alias("same")), "k")
    second = of_chunk.join(pairs.filter("a <> b").select(F.col("b").alias("k"), "p", F.lit(False).alias("same")), "k")
    sides = first.withColumn("side", F.lit(0)).unionAll(second.withColumn("side", F.lit(1))).drop("k")
    cosine = s.cosine

    def meet(rows: pa.Table) -> pa.Table:
        c, n, side = (rows.column(x).to_numpy() for x in ("c", "n", "side"))
        x, a, b = matrix(rows.column("x")), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = rows.column("same")[0].as_py()
        b = a if same else b
        link = linked(sent.value, x[a], x[b], cosine)
        count = np.zeros(len(c), np.int64)
        if same:
            link |= link.T
            np.fill_diagonal(link, False)
        else:
            count[b] += link.T @ n[a]
        count[a] += link @ n[b]
        i, j = np.nonzero(link)
        root = least_labels(len(c), a[i], b[j])
        keep = count > 0
        return pa.table({"c": c[keep], "links": count[keep], "root": c[root[keep]]})

    met = store.put("met", sides.groupBy("p").applyInArrow(meet, "c long, links long, root long"))
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    reached = components(met.select(F.col("c").alias("u"), F.col("root").alias("v")), store, "links")
    classed = classes.select("c", "n", "least").join(counts, "c", "left").join(reached.select(F.col("node").alias("c"), "component"), "c", "left")
    classed = classed.select("c", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("group"))
    classed = store.put("classed", classed)
    named = classed.groupBy("group").agg(F.min("least").alias("component"))
    found = members.join(classed.join(named, "group").select("c", "n_links", "component"), "c").select("id", "n_links", "component")
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.unionAll(alone).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
