"""MinHash near-duplicate detection: universal hash minima, banding, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import words as W
from inkframe.llm.columns import passing
from inkframe.llm.components import components
from inkframe.llm.pairs import Forest, compare_groups, deal_blocks
from inkframe.llm.store import Store

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Shingle size, similarity and the shape of the signature.

    At the threshold 0.75, 32 bands of 4 rows miss a link with probability
    (1 - 0.75 ** 4) ** 32, about 5e-6. Signatures reject below ``least`` of
    equal rows, five standard deviations under 0.75. ``block`` is the number
    of members of a group that one task compares with each other; the full
    shingle sets of a block have about ``block_bytes`` at most.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    least: float = 0.56
    block: int = 512
    block_bytes: int = 64 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240229).integers(0, 1 << 63, size=(2, n), dtype=np.int64).astype(U)
    return values[0] * U(2) + U(1), values[1] * U(2)


def shingles(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash, and the text of each.

    A text with fewer than k words but at least one has its whole sequence as
    its only shingle; a text without words has none.
    """
    at, h = W.windows(w, k)
    text = w.text[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole, _ = W.sequence_keys(w)
        text, h = np.concatenate([text, short]), np.concatenate([h, whole[short]])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        fresh = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
        text, h = text[fresh], h[fresh]
    return text, h


def minima(text: np.ndarray, h: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x hashes, 32 bits) and which texts have one."""
    out = np.zeros((n, s.hashes), dtype=np.uint32)
    has = np.zeros(n, dtype=bool)
    if len(h):
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        has[text[starts]] = True
        a, b = _universal(s.hashes)
        for j in range(s.hashes):
            value = ((h * a[j] + b[j]) >> U(32)).astype(np.uint32)
            out[text[starts], j] = np.minimum.reduceat(value, starts)
    return out, has


def band_keys(signatures: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit bucket key per text and band; the band is part of the key."""
    rows = signatures.reshape(len(signatures), s.bands, s.rows).astype(U)
    place = W._places(s.rows)
    total = np.zeros(rows.shape[:2], dtype=U)
    for j in range(s.rows):
        total += W.mix(rows[:, :, j] + U(j + 1)) * place[j]
    return W.mix(total + np.arange(1, s.bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows, dtype=np.uint8))])


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells the texts of one doc_id apart."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("h"))


def sketch(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id, hash of the text, sequence key (k1, k2), n_shingles, and for texts with words their bands and short signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                w = W.split(data, offsets[low : high + 1], lower=True)
                n = high - low
                text, h = shingles(w, s.shingle)
                signature, has = minima(text, h, n, s)
                k1, k2 = W.sequence_keys(w)
                bands = band_keys(signature, s).view(np.int64)
                sizes = np.where(has, s.bands, 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(bands[has].reshape(-1), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, n) for c in ("doc_id", "h")),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                        lists,
                        _fixed((signature & np.uint32(255)).astype(np.uint8)),
                    ],
                    names=["doc_id", "h", "k1", "k2", "n_shingles", "bands", "short"],
                )

    return _rows(documents).mapInArrow(run, "doc_id long, h long, k1 long, k2 long, n_shingles long, bands array<long>, short binary")


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = np.frombuffer(offsets, wide)[column.offset] if len(column) else 0
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width * size].view(kind).reshape(len(column), width)


def _meetings(block: np.ndarray, same: bool) -> tuple[np.ndarray, Iterator[tuple[int, int]]]:
    """An order of the rows, and (i, low): row i has still to meet the rows from low on.

    Members of one block meet those after them; of two blocks, each row of the
    first meets all of the second.
    """
    order = np.argsort(block, kind="stable")
    n = len(block)
    if same:
        return order, ((i, i + 1) for i in range(n - 1))
    second = int(np.searchsorted(block[order], block[order[0]], side="right"))
    return order, ((i, second) for i in range(second if second < n else 0))


def close_signatures(buckets: DataFrame, s: Settings) -> DataFrame:
    """Edges that connect, within a bucket, documents with close signatures."""
    least = s.least * s.hashes

    def compare(rows: pa.RecordBatch, block: np.ndarray, same: bool, forest: Forest, edges: list) -> None:
        order, meetings = _meetings(block, same)
        ids = rows.column("node").to_numpy()[order].tolist()
        short = _matrix(rows.column("short"), s.hashes, np.uint8)[order]
        for i, low in meetings:
            equal = np.count_nonzero(short[low:] == short[i], axis=1)
            for j in (np.flatnonzero(equal >= least) + low).tolist():
                if forest.join(ids[i], ids[j]):
                    edges.append((ids[i], ids[j]))

    return compare_groups(buckets, "bucket", ["node", "short"], compare)


def full_sets(documents: DataFrame, s: Settings) -> DataFrame:
    """Every column but text, and the signature and sorted distinct shingle hashes of each document, as bytes."""
    keep = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                n = high - low
                text, h = shingles(W.split(data, offsets[low : high + 1], lower=True), s.shingle)
                signature, _ = minima(text, h, n, s)
                bounds = np.append(0, np.cumsum(np.bincount(text, minlength=n))).astype(np.int32) * 8
                sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, n) for c in keep), _fixed(signature.view(np.uint8).reshape(n, -1)), sets],
                    names=[*keep, "signature", "shingles"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    return documents.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", signature binary, shingles binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def true_links(families: DataFrame, s: Settings) -> DataFrame:
    """Edges that connect documents whose full shingle sets reach the similarity."""
    least, percent = s.least * s.hashes, s.percent

    def compare(rows: pa.RecordBatch, block: np.ndarray, same: bool, forest: Forest, edges: list) -> None:
        order, meetings = _meetings(block, same)
        ids = rows.column("node").to_numpy()[order].tolist()
        signatures = _matrix(rows.column("signature"), s.hashes, np.uint32)[order]
        packed = rows.column("shingles")

        def of(i: int) -> np.ndarray:
            return np.frombuffer(packed[int(order[i])].as_buffer(), U)

        for i, low in meetings:
            equal = np.count_nonzero(signatures[low:] == signatures[i], axis=1)
            near = np.flatnonzero(equal >= least)
            # The likeliest first, so that later pairs are often already connected.
            for j in (near[np.argsort(-equal[near], kind="stable")] + low).tolist():
                if forest.root(ids[i]) != forest.root(ids[j]):
                    x, y = of(i), of(j)
                    common = _common(x, y)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        forest.join(ids[i], ids[j])
                        edges.append((ids[i], ids[j]))

    return compare_groups(families, "family", ["node", "signature", "shingles"], compare)


def _link(documents: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and of each class its (k1, k2), rep, component and the component's least doc_id.

    1. One pass makes sketches. Rows with equal word sequences form a class,
       which is a node from here on, with its least doc_id as ``rep``. Two
       classes may have one rep, if rows repeat a doc_id.
    2. Classes that share a bucket are compared by signature, larger buckets in
       pairs of blocks; what is close forms families.
    3. Within families full shingle sets are compared; confirmed links give
       the components.
    """
    store = Store(documents.sparkSession, "near")
    sketches = store.put("sketches", sketch(documents, s))
    reps = store.put(
        "reps",
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("short").alias("short"))
        .select("k1", "k2", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("rep_h"), "n_shingles", "bands", "short")
        .withColumn("node", F.monotonically_increasing_id()),  # fixed by the written table
    )
    spots = reps.select("node", F.explode("bands").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = spots.join(shared, "bucket").join(reps.select("node", "short"), "node")
    close = store.put("close", close_signatures(deal_blocks(met, "bucket", F.col("members"), "node", 2 * s.block), s))
    families = store.put("families", components(close, store, "family").withColumnRenamed("component", "family"))
    store.release()

    known = families.join(reps.select("node", "rep", "rep_h", (8 * F.col("n_shingles")).alias("volume")), "node")
    sizes = known.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("volume").alias("total"))
    listed = known.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"), "node", "family").join(sizes, "family")
    texts = _rows(documents).join(listed, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])  # a class's least row, once
    sets = full_sets(texts, s)
    links = store.put("links", true_links(deal_blocks(sets, "family", F.col("members"), "node", s.block, F.col("total"), s.block_bytes), s))
    labels = store.put("labels", components(links, store, "component"))
    store.drop("close", "families")
    store.release()

    least = labels.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    named = labels.join(least, "component").select("node", "least")
    own = F.struct("rep", "node")
    classes = reps.join(named, "node", "left").select("k1", "k2", "rep", "node", F.coalesce("least", own).alias("least"))
    return sketches, classes


def near_duplicates(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null and empty texts, and texts without words, have n_shingles 0 and are
    linked with nothing. Rows that repeat a doc_id are returned as often as
    they come, each with the least doc_id that its own text reaches. A row with
    a null doc_id takes no part in links: its component_id is null and it is
    kept. An empty table gives an empty result; columns other than doc_id and
    text are not read.
    """
    sketches, classes = _link(documents, s)
    own = F.col("n_shingles") == 0
    labels = classes.select("k1", "k2", F.col("least.rep").alias("component"))
    found = sketches.select("doc_id", "k1", "k2", "n_shingles").join(labels, ["k1", "k2"], "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(own | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each group of near-duplicates, all columns: one of least doc_id.

    Links are those of ``near_duplicates``. Of rows that repeat a doc_id in one
    group one stays: of rows that are equal in doc_id and text but not in other
    columns, that is any of them. Rows without words, whose doc_id or text is
    null, all stay. An empty table stays empty; columns of any other name pass.
    """
    return passing(documents, ("doc_id", "text"), lambda d: _deduplicate(d, s))


def _deduplicate(documents: DataFrame, s: Settings) -> DataFrame:
    names = documents.columns
    _, classes = _link(documents, s)
    kept = classes.filter("node = least.node").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("rep").alias("__rep"))
    keyed = _with_keys(documents).join(kept, ["__k1", "__k2"], "left")
    free = F.col("__free") | F.col("doc_id").isNull()
    alone = keyed.filter(free)
    first = keyed.filter(~free & (F.col("doc_id").cast("long") == F.col("__rep"))).dropDuplicates(["__k1", "__k2"])
    return alone.unionAll(first).select(*(F.col(f"`{c}`") for c in names))


def _with_keys(documents: DataFrame) -> DataFrame:
    """All columns, the sequence key (__k1, __k2) and whether there are no words."""
    names = documents.columns
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                w = W.split(data, offsets[low : high + 1], lower=True)
                keys = [pa.array(k.view(np.int64)) for k in W.sequence_keys(w)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(low, high - low) for c in batch.columns), *keys, pa.array(np.diff(w.first) == 0)], names=[*names, "__k1", "__k2", "__free"]
                )

    return documents.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __k1 long, __k2 long, __free boolean")
