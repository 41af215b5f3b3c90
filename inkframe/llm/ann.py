"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.llm.store import Store


@dataclass(frozen=True)
class Settings:
    """Shape of the index and the width of a search.

    Centroids and codebooks are fitted on at most ``sample`` vectors drawn by a
    hash of their id; every vector is indexed. There are about ``lists_per_root``
    times the root of the number of vectors lists. How many of them a query
    opens is measured, not set: as many, nearest first, as hold the share
    ``recall`` of the true neighbours of ``asked`` sample vectors in the sample,
    ``least_lists`` at least, and more until they hold k candidates. Vectors in
    clusters need few lists, vectors without need most. A query ranks the best
    ``rerank`` of each block, and all that tie with the last, by their true
    cosine; ``block`` rows of a list meet as many queries in one task.
    """

    sample: int = 20_000
    lists_per_root: float = 0.5
    most_lists: int = 4096
    recall: float = 0.97
    asked: int = 500
    least_lists: int = 4
    parts: int = 16
    codes: int = 64
    rerank: int = 32
    block: int = 8192
    rounds: int = 8
    seed: int = 5


#: Entries of a matrix of distances that is held at once.
CELLS = 1 << 22


def _distances(x: np.ndarray, centre: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances less the row's own square) of slices of x."""
    square = (centre * centre).sum(axis=1)
    step = max(1, CELLS // len(centre))
    for low in range(0, len(x), step):
        yield low, square - 2 * x[low : low + step] @ centre.T


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance less the row's own square."""
    near, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    for low, d in _distances(x, centre):
        at = d.argmin(axis=1)
        near[low : low + len(d)], distance[low : low + len(d)] = at, d[np.arange(len(d)), at]
    return near, distance


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cluster restarts at a far vector."""
    k = max(1, min(k, len(x)))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, distance = _nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        full = n > 0
        centre[full] = total[full] / n[full, None]
        if not full.all():
            centre[~full] = x[np.argsort(-distance, kind="stable")[: int((~full).sum())]]
    return centre


@dataclass(frozen=True)
class Index:
    """Coarse centroids and, per part of the vector, the codebook of residuals."""

    centroids: np.ndarray
    books: list[np.ndarray]
    bounds: list[int]

    def place(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)[0]

    def by_distance(self, x: np.ndarray) -> np.ndarray:
        """All lists of each row, nearest first."""
        return np.concatenate([np.argsort(d, axis=1, kind="stable") for _, d in _distances(x, self.centroids)])

    def encode(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[place]
        out = np.empty((len(x), len(self.books)), np.uint8)
        for i, book in enumerate(self.books):
            part = rest[:, self.bounds[i] : self.bounds[i + 1]]
            out[:, i] = _nearest(part, book)[0]
        return out

    def distances(self, query: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to coded vectors of one list, by a table per part."""
        rest = query - self.centroids[place]
        total = np.zeros(len(codes))
        for i, book in enumerate(self.books):
            table = ((rest[self.bounds[i] : self.bounds[i + 1]] - book) ** 2).sum(1)
            total += table[codes[:, i]]
        return total


def fit(x: np.ndarray, n: int, s: Settings) -> Index:
    """An index for n vectors, fitted on unit vectors x."""
    rng = np.random.default_rng(s.seed)
    k = max(1, min(s.most_lists, round(s.lists_per_root * math.sqrt(n))))
    centroids = kmeans(x, k, s.rounds, rng)
    bounds = np.linspace(0, x.shape[1], min(s.parts, x.shape[1]) + 1).astype(int).tolist()
    rest = x - centroids[_nearest(x, centroids)[0]]
    books = [kmeans(rest[:, a:b], s.codes, s.rounds, rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return Index(centroids, books, bounds)


def lists_to_open(x: np.ndarray, index: Index, k: int, s: Settings) -> int:
    """How many lists hold the wanted share of the k true neighbours of sample vectors."""
    if len(x) < 2:
        return 1
    asked = np.arange(0, len(x), max(1, len(x) // s.asked))
    place, k, ranks = index.place(x), min(k, len(x) - 1), []
    for low in range(0, len(asked), 100):
        rows = asked[low : low + 100]
        score = x[rows] @ x.T
        score[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = index.by_distance(x[rows])
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        ranks.append(np.take_along_axis(rank, place[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), s.recall, method="higher")) + 1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by its largest component first, so that no square is out of range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors that take part: not null, of finite components, not zero."""
    values = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), values.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda v: v != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """v and its ``keep`` smallest ids, one row per distinct vector.

    Spark cuts the ranks before the shuffle, so that a vector with many copies
    sends few rows.
    """
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.withColumn("__r", order).filter(F.col("__r") <= keep)
    copies = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return copies.select(F.get("ids", F.lit(0)).alias("id"), "v", "ids")


def candidates(near: np.ndarray, n: int) -> np.ndarray:
    """Where the n smallest values are, and all that equal the largest of them."""
    if len(near) <= n:
        return np.arange(len(near))
    return np.flatnonzero(near <= np.partition(near, n - 1)[n - 1])


def open_lists(order: np.ndarray, rows: np.ndarray, ids: np.ndarray, least: int, share: float, k: int) -> list[np.ndarray]:
    """The lists each query opens: ``least``, and more until they hold ``share``
    of all vectors and k ids besides the query's own; ``rows`` and ``ids`` count
    the vectors and ids of each list."""
    enough = (np.cumsum(rows[order], axis=1) >= share * rows.sum()) & (np.cumsum(ids[order], axis=1) > k)
    first = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
    return [lists[:n] for lists, n in zip(order, np.maximum(first, least).tolist(), strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank, the found id and its exact cosine, for rows that fulfil ``is_query`` over ``id``.

    Candidates are all other ids. Rows whose vector is null, zero or has null
    or non-finite components take no part, nor do rows with a null id. Vectors
    must have one length; those of another length than the most common are left
    out, too. Rows that repeat an id are one vector. Equal cosines go to the
    smaller id. Equal vectors are indexed once, with their k + 1 smallest ids.
    Lists are opened until they hold k candidates at least, so only a table
    with fewer gives a query fewer rows. An empty table, or one without
    queries, gives an empty result.
    """
    spark = vectors.sparkSession
    store = Store(spark, "ann")
    rows = usable(vectors, key, vector)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if width is None:
        return empty
    rows = store.put("vectors", rows.filter(F.size("v") == width["d"]).dropDuplicates(["id"]))
    distinct = store.put("distinct", distinct_vectors(rows, k + 1))
    n = distinct.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), F.col("id")), 11).cast("double") / F.lit(float(1 << 53))
    chosen = distinct.filter(draw < min(1.0, s.sample / n)).orderBy(F.xxhash64(F.lit(s.seed), F.col("id")), "id").limit(s.sample).toArrow()
    x = unit(_matrix(chosen.column("v").combine_chunks()))
    index = fit(x, n, s)
    opened = min(len(index.centroids), max(s.least_lists, lists_to_open(x, index, k, s)))
    sent = spark.sparkContext.broadcast(index)  # at most most_lists + codes rows of one vector's width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("v")))
            place = made.place(x)
            codes = made.encode(x, place)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "v", "ids")), pa.array(place, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["id", "v", "ids", "list", "codes"],
            )

    listed = store.put("lists", distinct.mapInArrow(assign, "id long, v array<double>, ids array<long>, list int, codes binary"))
    held = np.zeros((3, len(index.centroids)), np.int64)  # vectors, ids and queries of each list
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # at most most_lists rows
        held[:2, r["list"]] = r["n"], r["ids"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = made.by_distance(unit(_matrix(batch.column("v"))))
            lists = open_lists(order, held[0], held[1], opened, 0.0, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "v", "lists"]
            )

    asked = store.put("asked", rows.filter(is_query).mapInArrow(probe, "id long, v array<double>, lists array<int>"))
    for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # at most most_lists rows
        held[2, r["list"]] = r["count"]
    cuts = np.maximum(1, -(-held[[0, 2]] // s.block))
    sizes = F.broadcast(spark.createDataFrame([(i, *c) for i, c in enumerate(cuts.T.tolist())], "list int, blocks int, parts int"))

    def cut(name: str, others: str) -> tuple[Column, Column]:
        """A row's own block by its id, and every block of the other side that it meets."""
        return F.pmod(F.xxhash64(F.lit(name), F.col("id")), F.col(name)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))

    mine, all_parts = cut("blocks", "parts")
    stored = listed.join(sizes, "list").select("list", mine.alias("block"), all_parts.alias("part"), "v", "ids", "codes")
    own, all_blocks = cut("parts", "blocks")
    asked = asked.select("id", "v", F.explode("lists").alias("list")).join(sizes, "list")
    asked = asked.select("list", all_blocks.alias("block"), own.alias("part"), "id", "v")

    def meet(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made, place = sent.value, int(key_[0])
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            ids = np.concatenate(right["ids"].to_list())
            copies = right["ids"].map(len).to_numpy()
            first = np.cumsum(copies) - copies
            x = unit(np.stack(right["v"].to_list()))
            codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
            for query, q in zip(left["id"].tolist(), unit(np.stack(left["v"].to_list())), strict=True):
                near = made.distances(q, place, codes)
                # One more than k, as the query's own vector may be among them.
                take = candidates(near, max(s.rerank, k + 1))
                each = np.repeat(take, copies[take])
                inside = np.arange(len(each)) - np.repeat(np.cumsum(copies[take]) - copies[take], copies[take])
                found = ids[first[each] + inside]
                score = np.repeat(np.clip(x[take] @ q, -1.0, 1.0), copies[take])
                found, score = found[found != query], score[found != query]
                best = np.lexsort((found, -score))[:k]
                out.extend(zip([query] * len(best), found[best].tolist(), score[best].tolist(), strict=True))
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    keys = ("list", "block", "part")
    pairs = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
