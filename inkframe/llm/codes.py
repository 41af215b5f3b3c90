"""Vector code compression: integer parts, one weighted row per distinct part, Lloyd's rounds over those.

A vector is cut into consecutive parts of integers. Equal parts at a position
are one row with a weight, so a round reads each distinct part once, however
many vectors hold it. A round's sums are made per task, added up by Spark, and
only ``entries`` rows per position reach the driver. At the end each distinct
part has a code and an error, and a join brings them back to the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.store import Store
from inkframe.llm.vectors import common_width, finite, largest, matrix, scaled


@dataclass(frozen=True)
class Settings:
    """Components become floor(scale * x); ``parts`` positions have ``entries``
    codes each, found in ``rounds`` rounds. A part that more than one in
    ``hot_share`` of the vectors holds is joined by a broadcast of at most
    parts x hot_share rows, so no key of the shuffled join is hot."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    hot_share: int = 1024


@dataclass(frozen=True)
class Compressed:
    """``rows``: key, label, codes array<int>, error long, of each vector that took part.
    ``books[position][entry]`` is a codebook entry, integers."""

    rows: DataFrame
    books: np.ndarray
    scale: int

    def decode(self) -> DataFrame:
        """``rows`` with ``decoded``: the vector that the codes stand for."""
        flat = F.array(*(F.array(*(F.array(*(F.lit(float(x) / self.scale) for x in entry)) for entry in book)) for book in self.books.tolist()))
        pieces = F.transform(F.col("codes"), lambda code, at: F.get(F.get(flat, at), code))
        return self.rows.withColumn("decoded", F.flatten(pieces))


#: Distances that are held at once.
CELLS = 1 << 20


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each row, exact in integers; ties go to the lower code."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, CELLS // book.size)
    for low in range(0, len(x), step):
        d = ((x[low : low + step, None, :] - book[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        code[low : low + step], error[low : low + step] = at, d[np.arange(len(d)), at]
    return code, error


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, part, code and error of each row of a batch."""
    position, part = batch.column("position").to_numpy(), matrix(batch.column("part"))
    code, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        code[rows], error[rows] = nearest(part[rows], books[p])
    return position, part, code, error


def next_books(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of its parts; an entry without parts stays."""
    positions, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                position, part, code, _ = _assigned(batch, books)
                weight = batch.column("weight").to_numpy()
                np.add.at(total, (position, code), part * weight[:, None])
                np.add.at(count, (position, code), weight)
        p, e = np.nonzero(count)
        if len(p):
            flat = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), flat], names=["position", "entry", "n", "sums"])

    found = distinct.mapInArrow(add, "position int, entry int, n long, sums array<long>")
    each = found.select("position", "entry", "n", F.posexplode("sums").alias("at", "total"))
    summed = each.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    made = books.copy()
    for r in summed.collect():  # at most entries rows per component of a vector
        made[r["position"], r["entry"], r["at"]] = r["total"] // r["n"]
    return made


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", s: Settings = Settings()) -> Compressed:
    """Codes and errors of all vectors, and the codebooks.

    Rows whose vector is null, empty or has null or non-finite components are
    left out, as are vectors of another length than the most common one. The
    first codebooks are the parts of the rows with the smallest ids (null ids
    last, rows of one id by their vector); a table with fewer rows than
    ``entries`` has as many entries as rows. Rows that repeat an id are coded
    each by itself; labels may be null. An empty table gives no rows and empty
    books. A length that ``parts`` doesn't divide, and components so large that
    sums leave 64 bits, are errors. Other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "codes")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    width = common_width(rows, "v")
    if width is None:
        empty = rows.select(F.col("id").alias(key), F.col("label").alias("label"), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Compressed(empty, np.zeros((s.parts, 0, 0), np.int64), s.scale)
    if width % s.parts:
        raise ValueError(f"vectors of {width} components have no {s.parts} equal parts")
    rows = rows.filter(F.size("v") == width)
    size = largest(rows, "v") * s.scale + 1
    if width * (2 * size) ** 2 >= 2**62:
        raise ValueError(f"components of up to {size:g} steps are too large for exact sums")
    rows = store.put("rows", rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", scaled(F.col("v"), s.scale).alias("v")))
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(s.entries).collect()
    step = width // s.parts
    books = np.array([[r["v"][p * step : (p + 1) * step] for r in first] for p in range(s.parts)], np.int64)

    cut = F.posexplode(F.array(*(F.slice("v", p * step + 1, step) for p in range(s.parts)))).alias("position", "part")
    parts = rows.select("row", cut)
    distinct = store.put("distinct", parts.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")))
    for _ in range(s.rounds):
        books = next_books(distinct, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, codes, errors = _assigned(batch, books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32()), pa.array(errors)], names=["position", "part", "weight", "code", "error"])

    coded = store.put("coded", distinct.mapInArrow(code, "position int, part array<long>, weight long, code int, error long"))
    total = rows.count()
    often = F.col("weight") * s.hot_share > total
    keys = ["position", "part"]
    hot = F.broadcast(coded.filter(often).select(*keys, "code", "error"))  # at most parts x hot_share rows
    rest = coded.filter(~often).select(*keys, "code", "error")
    found = parts.join(hot, keys).unionAll(parts.join(hot, keys, "left_anti").join(rest, keys))
    at = [F.max(F.when(F.col("position") == p, F.col("code"))) for p in range(s.parts)]
    back = found.groupBy("row").agg(F.array(*at).alias("codes"), F.sum("error").alias("error"))
    return Compressed(rows.select("row", "id", "label").join(back, "row").select(F.col("id").alias(key), "label", "codes", "error"), books, s.scale)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels; null labels are one group.

    Errors are added before the shuffle, and the sums joined back.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("__label"), "label_error")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
