"""Quality rules: counts of a text, and the frequency of its lines across documents of a host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm import words as W
from inkframe.llm.columns import passing
from inkframe.llm.store import Store

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = 0x0A


@dataclass(frozen=True)
class Settings:
    """Limits of the rules.

    A line is frequent on a host if more distinct documents of the host have it
    than ``least_documents`` and than ``share`` of its distinct documents. A
    document is depleted if frequent lines hold more than ``depleted`` percent
    of its words. Distinct documents are documents with distinct words: equal
    texts count as one, as copies would make all of their own lines frequent
    and reject each other, the first of them too.
    """

    least_words: int = 50
    repeat_percent: int = 50
    least_documents: int = 20
    share: float = 0.02
    depleted: int = 70
    #: A table of frequent lines up to this many rows is broadcast; a larger one is joined by host.
    broadcast_rows: int = 100_000


@dataclass
class _Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def count(data: np.ndarray, offsets: np.ndarray) -> _Counts:
    """The base counts of the texts between ``offsets``."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    local = offsets - base
    n = len(local) - 1
    w = W.split(part, local)
    chars = _per_text(((part & 0xC0) != 0x80) & ~W.SPACE[part], local)
    symbols = _per_text(_SYMBOL[part], local)

    at, h = W.windows(w, 3)
    order = np.lexsort((h, w.text[at]))
    text, sorted_h = w.text[at][order], h[order]
    equal = (sorted_h[1:] == sorted_h[:-1]) & (text[1:] == text[:-1]) if len(at) else np.zeros(0, bool)
    twice = np.append(equal, False) | np.append(False, equal) if len(at) else np.zeros(0, bool)
    again = W.covered(at[order[twice]], 3, len(w.start))
    repeats = np.bincount(w.text[again], minlength=n).astype(np.int64)

    dups = np.zeros(n, np.int64)
    for i in np.flatnonzero(_per_text(part == _NEWLINE, local)).tolist():
        lines = [x for x in part[local[i] : local[i + 1]].tobytes().split(b"\n") if x.strip()]
        dups[i] = len(lines) - len(set(lines))
    return _Counts(np.diff(w.first), chars, symbols, dups, repeats)


@dataclass
class _Lines:
    """Lines that have words, in order: text, byte range, hash of the normalised line, words."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    words: np.ndarray
    content: np.ndarray  #: hash of each text's words


def lines(data: np.ndarray, offsets: np.ndarray) -> _Lines:
    """A line is normalised to its words, A-Z lower-cased."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    local = offsets - base
    bounds = np.union1d(local, np.flatnonzero(part == _NEWLINE) + 1)
    w = W.split(part, bounds, lower=True)
    key, _ = W.sequence_keys(w)
    n_words = np.diff(w.first)
    text = np.searchsorted(local, bounds[:-1], side="right") - 1
    has = n_words > 0
    whole = W.Words(w.start, w.end, text[w.text], w.hash, np.searchsorted(w.start, local))
    return _Lines(text[has], bounds[:-1][has] + base, bounds[1:][has] + base, key[has], n_words[has], W.sequence_keys(whole)[0])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(documents: DataFrame, counts: bool = True) -> DataFrame:
    """doc_id, host, base counts (if wanted), content hash and the hashes and word counts of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                n = high - low
                base = [pa.array(getattr(c, n).astype(np.int64)) for c in [count(data, offsets[low : high + 1])] for n in _COUNTS] if counts else []
                found = lines(data, offsets[low : high + 1])
                ends = pa.array(np.append(0, np.cumsum(np.bincount(found.text, minlength=n))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, n),
                        batch.column("host").slice(low, n),
                        *base,
                        pa.array(found.content.view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(found.hash.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(found.words.astype(np.int32))),
                    ],
                    names=["doc_id", "host", *(_COUNTS if counts else ()), "content", "line", "line_words"],
                )

    kinds = "".join(f"{n} long, " for n in _COUNTS) if counts else ""
    return documents.mapInArrow(run, f"doc_id long, host string, {kinds}content long, line array<long>, line_words array<int>")


def frequent_lines(measured: DataFrame, s: Settings) -> DataFrame:
    """host and its frequent lines, for hosts that have any.

    A line counts once per distinct content. Both counts are aggregated before
    they are shuffled, so a line or host that is everywhere is a few rows.
    """
    contents = measured.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    each = measured.select("host", "content", F.explode(F.array_distinct("line")).alias("line")).distinct()
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > s.least_documents)
    over = counted.join(contents, "host").filter(F.col("n") > F.col("documents") * F.lit(s.share))
    return over.select("host", "line")


def _with_frequent(frame: DataFrame, host: Column, frequent: DataFrame, rows: int, s: Settings) -> DataFrame:
    """Each row and its host's list of frequent lines.

    A host has at most (lines per document / share) frequent lines, so a list
    stays short. The table of lists grows with the number of hosts; it is
    broadcast only if its measured size is under the bound.
    """
    lists = frequent.groupBy("host").agg(F.collect_list("line").alias("__frequent")).withColumnRenamed("host", "__host")
    if rows <= s.broadcast_rows:
        lists = F.broadcast(lists)
    joined = frame.join(lists, F.coalesce(host.cast("string"), F.lit("")) == F.col("__host"), "left").drop("__host")
    return joined.withColumn("__frequent", F.coalesce("__frequent", F.array().cast("array<long>")))


def _base_failed(s: Settings) -> Column:
    return (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words"))


def _prepare(documents: DataFrame, host: str, s: Settings, counts: bool) -> tuple[DataFrame, DataFrame, int]:
    store = Store(documents.sparkSession, "lines")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").alias("text")
    )
    measured = store.put("measured", measure(rows, counts))
    frequent = store.put("frequent", frequent_lines(measured, s))
    return measured, frequent, frequent.count()


def assess(documents: DataFrame, host: str = "source", s: Settings = Settings()) -> DataFrame:
    """Counts and verdict of every document.

    A null text has no words, fails the base rules and is not kept, like an
    empty one. A null host counts as the empty host. Repeated rows are judged
    alike and count as one document of their host. An empty table gives an
    empty result. Columns other than doc_id, text and ``host`` are not read.
    """
    measured, frequent, rows = _prepare(documents, host, s, counts=True)
    judged = _with_frequent(measured, F.col("host"), frequent, rows, s)
    # The few lines of a text that are frequent are found by a hash set, then counted.
    judged = judged.withColumn("__hit", F.array_intersect("line", "__frequent"))
    pairs = F.filter(F.arrays_zip("line", "line_words"), lambda x: F.array_contains(F.col("__hit"), x["line"]))
    removed = F.when(F.size("__hit") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda total, x: total + x["line_words"]))
    failed = _base_failed(s)
    return judged.withColumn("removed_words", removed).select(
        "doc_id",
        *_COUNTS,
        failed.alias("base_failed"),
        "removed_words",
        (~failed & (100 * F.col("removed_words") <= s.depleted * F.col("n_words"))).alias("kept"),
    )


def clean(documents: DataFrame, host: str = "source", s: Settings = Settings()) -> DataFrame:
    """The kept documents, all columns, without their frequent lines.

    The verdicts are those of ``assess``; the same edge cases hold: null and
    empty texts go, repeated rows stay or go together, an empty table stays
    empty, and columns of any other name pass. A column n_chars, if there is
    one, is set to the length of the new text.
    """
    return passing(documents, ("doc_id", "text", "n_chars", host), lambda d: _clean(d, host, s))


def _clean(documents: DataFrame, host: str, s: Settings) -> DataFrame:
    _, frequent, rows = _prepare(documents, host, s, counts=False)
    names = documents.columns
    frame = _with_frequent(documents, F.col(f"`{host}`"), frequent, rows, s)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            often = batch.column("__frequent")
            for low, high in W.slices(offsets):
                n = high - low
                c = count(data, offsets[low : high + 1])
                found = lines(data, offsets[low : high + 1])
                first = np.searchsorted(found.text, np.arange(n + 1))
                keep = np.zeros(n, bool)
                texts: list[bytes | None] = []
                for i in range(n):
                    if c.n_words[i] < s.least_words or 100 * c.n_repeat_words[i] > s.repeat_percent * c.n_words[i]:
                        continue
                    mine = slice(int(first[i]), int(first[i + 1]))
                    listed = often[low + i].values
                    raw = data[offsets[low + i] : offsets[low + i + 1]].tobytes()
                    if listed is not None and len(listed):
                        gone = np.isin(found.hash[mine].view(np.int64), listed.to_numpy())
                        if 100 * int(found.words[mine][gone].sum()) > s.depleted * int(c.n_words[i]):
                            continue
                        if gone.any():
                            cut, at, base = [], 0, int(offsets[low + i])
                            for a, b in zip(found.start[mine][gone] - base, found.stop[mine][gone] - base, strict=True):
                                cut.append(raw[at:a])
                                at = int(b)
                            raw = b"".join([*cut, raw[at:]])
                    keep[i] = True
                    texts.append(raw)
                mask = pa.array(keep)
                fresh = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [fresh if x == "text" else batch.column(x).slice(low, n).filter(mask) for x in names], names=names
                )

    out = frame.select(*(F.col(f"`{x}`") for x in names), "__frequent").mapInArrow(run, ", ".join(f"`{x}` {kinds[x]}" for x in names))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return out
