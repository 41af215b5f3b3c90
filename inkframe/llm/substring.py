"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The index holds blocks of 13 words. An entry maps a block to its reference: the
least document that has it, and where it starts there. A document is parsed
greedily: a factor starts at the first indexed block and is extended by the
blocks after it for as long as their references follow each other in the same
document. Where the least document changes, the factor ends and the next one
starts, even if another reference would go on; so a passage may be several
factors, but what is removed is the same. Only blocks around
an anchor that two documents share are looked up; anchors are sampled so that
equal blocks sample alike, and a block is known by its anchor and its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import words as W
from inkframe.llm.store import Store

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """A duplicate span has at least ``window`` words; anchors are ``gram`` words long.

    Blocks of an anchor are looked up in one streaming pass over its runs. An
    anchor in more than ``hot`` rows is looked up by its single blocks instead,
    which are aggregated before they are shuffled and spread over tasks.
    """

    window: int = 13
    gram: int = 5
    hot: int = 10_000
    #: Runs, and blocks in them, that a task looks up at once, or a few more: those of one Arrow batch.
    runs: int = 100_000
    blocks: int = 1_000_000


def anchors(w: W.Words, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the word at which it starts, and its anchor.

    The anchor is the least gram of the window (in a hash order), so two equal
    windows have equal anchors, and neighbouring windows mostly share one.
    """
    at, gram = W.windows(w, s.gram)
    here = np.full(len(w.start), np.iinfo(np.uint64).max, dtype=U)
    here[at] = gram
    start, _ = W.windows(w, s.window)
    span = s.window - s.gram + 1
    least = here[start] if len(start) else np.zeros(0, U)
    for j in range(1, span):
        np.minimum(least, here[start + j], out=least)
    return start, least


@dataclass(frozen=True)
class Factor:
    """Words start..stop-1 of a document: the words of document ``source`` from ``source_start`` on."""

    start: int
    stop: int
    source: int
    source_start: int


def factorize(at: np.ndarray, n: np.ndarray, source: np.ndarray, copy: np.ndarray, pos: np.ndarray, window: int) -> list[Factor]:
    """Greedy parse of one document, given what the index says of its blocks.

    Entry i tells that ``n[i]`` blocks from word ``at[i]`` on, ascending, are
    those from word ``pos[i]`` on of row ``copy[i]`` of document ``source[i]``.
    A factor starts at the first indexed block and is extended by the next
    blocks while they stand one after another in the same reference. At its end
    the parse does not skip the blocks that straddle the boundary: the next
    factor may start at any of them. Words outside all factors are literals.
    """
    out: list[Factor] = []
    last: tuple = ()
    for a, k, *reference in zip(at.tolist(), n.tolist(), source.tolist(), copy.tolist(), pos.tolist(), strict=True):
        if last == (a, *reference):
            old = out.pop()
            out.append(Factor(old.start, a + k - 1 + window, old.source, old.source_start))
        else:
            out.append(Factor(a, a + k - 1 + window, reference[0], reference[2]))
        last = (a + k, reference[0], reference[1], reference[2] + k)
    return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


ROW = "doc_id long, tie long"


def sample_anchors(rows: DataFrame, s: Settings) -> DataFrame:
    """doc_id, tie and the distinct anchors of the windows of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                w = W.split(data, offsets[low : high + 1])
                at, anchor = anchors(w, s)
                text = w.text[at]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(at) else np.zeros(0, bool)
                counts = np.bincount(text[fresh], minlength=high - low)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("doc_id", "tie")), _lists(anchor[fresh].view(np.int64), counts, pa.int64())],
                    names=["doc_id", "tie", "anchors"],
                )

    return rows.select("doc_id", "tie", "text").mapInArrow(run, f"{ROW}, anchors array<long>")


def cut_blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """Runs of neighbouring blocks with one anchor, for anchors in ``shared`` or ``hot``.

    An anchor in any document's list is shared whichever document has it, so
    the lists of a batch are pooled.
    """

    def pool(lists: pa.Array) -> np.ndarray:
        found = np.unique(lists.flatten().to_numpy()).view(U)
        found.sort()
        return found

    def within(anchor: np.ndarray, found: np.ndarray) -> np.ndarray:
        return found[np.minimum(np.searchsorted(found, anchor), len(found) - 1)] == anchor if len(found) else np.zeros(len(anchor), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                w = W.split(data, offsets[low : high + 1])
                at, anchor = anchors(w, s)
                _, block = W.windows(w, s.window)
                hot = within(anchor, pool(batch.column("hot").slice(low, high - low)))
                hit = hot | within(anchor, pool(batch.column("shared").slice(low, high - low)))
                at, anchor, block, hot = at[hit], anchor[hit], block[hit], hot[hit]
                text = w.text[at]
                first = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])) if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(first)
                owner = pa.array(text[first] + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(owner) for c in ("doc_id", "tie")),
                        pa.array(anchor[first].view(np.int64)),
                        pa.array((at[first] - w.first[text[first]]).astype(np.int32)),
                        _lists(block.view(np.int64), np.diff(np.append(first, len(at))), pa.int64()),
                        pa.array(hot[first]),
                    ],
                    names=["doc_id", "tie", "anchor", "at", "blocks", "hot"],
                )

    return rows.select("doc_id", "tie", "text", "shared", "hot").mapInArrow(run, f"{ROW}, anchor long, at int, blocks array<long>, hot boolean")


HIT = f"{ROW}, at int, n int, source long, copy long, pos int"


@dataclass
class _Blocks:
    """Single blocks in the order of anchor, doc_id, tie and place."""

    anchor: np.ndarray
    block: np.ndarray
    doc: np.ndarray
    tie: np.ndarray
    at: np.ndarray

    def take(self, where: np.ndarray) -> "_Blocks":
        return _Blocks(*(getattr(self, f)[where] for f in self.__dataclass_fields__))

    @classmethod
    def of(cls, parts: list["_Blocks"]) -> "_Blocks":
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in cls.__dataclass_fields__))

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> "_Blocks":
        width = batch.column("blocks").value_lengths().to_numpy()
        columns = [np.repeat(batch.column(c).to_numpy(), width) for c in ("anchor", "doc_id", "tie", "at")]
        inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        return cls(columns[0], batch.column("blocks").flatten().to_numpy(), columns[1], columns[2], columns[3] + inside)


def look_up(runs: DataFrame, s: Settings) -> DataFrame:
    """Blocks that an earlier document has, as runs that are contiguous in it, too.

    Runs come sorted, so the first row with a block is its reference. A task
    holds ``s.runs`` runs or ``s.blocks`` blocks, however many of them a run
    has, and of the last anchor the references so far: its distinct blocks.
    """

    def find(carried: _Blocks, held: list[_Blocks]) -> tuple[_Blocks, pa.RecordBatch]:
        b = _Blocks.of([carried, *held])
        order = np.lexsort((b.block, b.anchor))
        key_anchor, key = b.anchor[order], b.block[order]
        new = np.append(True, (key_anchor[1:] != key_anchor[:-1]) | (key[1:] != key[:-1]))
        least = order[np.flatnonzero(new)]  # the sort is stable
        reference = np.empty(len(order), np.int64)
        reference[order] = least[np.cumsum(new) - 1]
        hit = b.doc[reference] < b.doc
        hit[: len(carried.doc)] = False
        at = np.flatnonzero(hit)
        r = reference[at]
        columns = [b.doc[at], b.tie[at], b.at[at], b.doc[r], b.tie[r], b.at[r]]
        same = np.ones(max(len(at) - 1, 0), bool)
        for c, step in zip(columns, (0, 0, 1, 0, 0, 1), strict=True):
            same &= c[1:] == c[:-1] + step
        first = np.flatnonzero(np.append(True, ~same)) if len(at) else np.zeros(0, np.int64)
        doc, tie, start, source, copy, pos = (c[first] for c in columns)
        n = np.diff(np.append(first, len(at)))
        found = [pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(source), pa.array(copy), pa.array(pos.astype(np.int32))]
        out = pa.RecordBatch.from_arrays(found, names=["doc_id", "tie", "at", "n", "source", "copy", "pos"])
        return b.take(np.sort(least[b.anchor[least] == b.anchor[-1]])), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        carried = _Blocks(none, none, none, none, none)
        held: list[_Blocks] = []
        runs = blocks = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_Blocks.read(batch))
            runs, blocks = runs + batch.num_rows, blocks + len(held[-1].block)
            if runs >= s.runs or blocks >= s.blocks:
                carried, out = find(carried, held)
                held, runs, blocks = [], 0, 0
                yield out
        if held:
            yield find(carried, held)[1]

    cold = runs.select("anchor", "doc_id", "tie", "at", "blocks").repartition("anchor")
    return cold.sortWithinPartitions("anchor", "doc_id", "tie", "at").mapInArrow(run, HIT)


def look_up_single(runs: DataFrame) -> DataFrame:
    """As ``look_up``, block by block: for anchors that are in very many rows.

    References are aggregated before the shuffle, and are one row per block on
    the other side of the join, so that a block with many rows can be split.
    """
    cut = runs.select("doc_id", "tie", "anchor", "at", F.posexplode("blocks").alias("i", "block"))
    cut = cut.select("doc_id", "tie", "anchor", "block", (F.col("at") + F.col("i")).cast("int").alias("at"))
    index = cut.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "tie", "at")).alias("r"))
    hits = cut.join(index, ["anchor", "block"]).filter("r.doc_id < doc_id")
    reference = [F.col("r.doc_id").alias("source"), F.col("r.tie").alias("copy"), F.col("r.at").alias("pos")]
    return hits.select("doc_id", "tie", "at", F.lit(1).alias("n"), *reference)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))


def remove_factors(found: DataFrame, s: Settings) -> DataFrame:
    """Parse rows with lists ``hits``; every column but text and hits, words, removed spans and the kept text."""
    keep = [c for c in found.columns if c not in ("text", "hits")]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            hits = batch.column("hits")
            for low, high in W.slices(offsets):
                w = W.split(data, offsets[low : high + 1], hashes=False)
                n_words, removed, texts, digests, spans = [], [], [], [], []
                for i in range(high - low):
                    first, stop = int(w.first[i]), int(w.first[i + 1])
                    starts, ends = w.start[first:stop], w.end[first:stop]
                    n = stop - first
                    listed = hits[low + i].values
                    factors: list[Factor] = []
                    gone = np.zeros(n, dtype=bool)
                    if listed is not None and len(listed):
                        columns = [c.to_numpy() for c in listed.flatten()]
                        order = np.argsort(columns[0], kind="stable")
                        factors = factorize(*(c[order] for c in columns), s.window)
                        for f in factors:
                            gone[f.start : f.stop] = True
                    left = np.flatnonzero(~gone)
                    kept = _join(data, starts[left], ends[left])
                    n_words.append(n)
                    removed.append(n - len(left))
                    texts.append(kept)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    spans.append([vars(f) for f in factors])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, high - low) for c in keep),
                        pa.array(n_words, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(digests, pa.string()),
                        pa.array(spans, _SPANS),
                    ],
                    names=[*keep, "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
                )

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return found.mapInArrow(
        run, schema + "n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:int,stop:int,source:long,source_start:int>>"
    )


def _join(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space, cut from the text in one pass."""
    if not len(starts):
        return b""
    width = ends - starts + 1
    total = int(width.sum())
    place = np.arange(total) - np.repeat(np.cumsum(width) - width, width)
    out = data[np.minimum(np.repeat(starts, width) + place, len(data) - 1)]
    out[np.cumsum(width) - 1] = 0x20
    return out[:-1].tobytes()


def duplicate_spans(documents: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Remove words of 13-word blocks that start in an earlier document too.

    Returns the columns ``keep`` of ``documents``, n_words, n_removed,
    kept_text, kept_sha256 and the factors as spans (start, stop, source,
    source_start), in words of the input; ``prefix`` goes before those five
    names. Documents are judged on the input, not on what is left of others.
    Blocks that repeat only inside one document stay.

    A null text has no words. Rows that repeat a doc_id are judged one by one,
    each by its own text, and are not sources for each other. A row with a null
    doc_id is neither source nor judged. Texts with fewer words than a block,
    empty texts and an empty table are returned as they are, words joined by
    one space.
    """
    store = Store(documents.sparkSession, "factors")
    names = [f"__keep{i}" for i in range(len(keep))]
    whole = documents.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.xxhash64("text").alias("tie"),  # tells rows of one doc_id apart
    )
    rows = whole.select("doc_id", "tie", "text").filter("doc_id IS NOT NULL")
    # Each step is a written table; the frames of a step end with its call, so
    # that Spark can delete its shuffle files before the next one.
    marks = store.put("marks", _mark_shared(rows, s))
    store.release()
    runs = store.put("runs", cut_blocks(rows.join(marks, ["doc_id", "tie"]), s))
    store.drop("marks")
    store.release()
    hits = look_up(runs.filter("NOT hot"), s).unionAll(look_up_single(runs.filter("hot")))
    listed = hits.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("at", "n", "source", "copy", "pos")).alias("hits"))
    found = store.put("found", listed)
    store.drop("runs")
    store.release()
    judged = remove_factors(whole.join(found, ["doc_id", "tie"], "left"), s)
    made = ("n_words", "n_removed", "kept_text", "kept_sha256", "spans")
    return judged.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *(F.col(c).alias(prefix + c) for c in made))


def _mark_shared(rows: DataFrame, s: Settings) -> DataFrame:
    """doc_id, tie and those of the row's anchors that another document has, too, the hot ones apart.

    An anchor's least and greatest document are aggregated before the shuffle;
    the list of a document is as long as the document at most.
    """
    spots = sample_anchors(rows, s).select("doc_id", "tie", F.explode("anchors").alias("anchor"))
    shared = (
        spots.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high")
        .select("anchor", (F.col("n") > s.hot).alias("hot"))
    )
    listed = spots.join(shared, "anchor").groupBy("doc_id", "tie")
    lists = [F.collect_set(F.when(F.col("hot") == hot, F.col("anchor"))).alias(name) for hot, name in ((False, "shared"), (True, "hot"))]
    return listed.agg(*lists)
