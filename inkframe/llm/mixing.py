"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm import words as W
from inkframe.llm.columns import passing
from inkframe.llm.store import Store

#: Every source or language that is not among the largest, if Settings bounds them.
REST = "~rest"
#: Up to so many cells the driver rakes and documents are joined by broadcast.
LOCAL_CELLS = 200_000
AXES = ("source", "language", "topic")


@dataclass(frozen=True)
class Settings:
    """Targets of the mixture.

    ``source_targets``, ``language_targets`` and ``topic_targets`` are weights
    by name; a name without one has weight 0 and is left out. Without them a
    marginal's target share is its share of the tokens to a power: 1 keeps the
    corpus's shares, 0 makes them equal. Weights are scaled to sum to one. The
    sample has ``fraction`` of all tokens in expectation. Every source and
    language has a margin of its own. Who wants less sets ``sources`` or
    ``languages``: then all but the largest so many are one margin together.
    """

    fraction: float = 0.6
    source_power: float = 0.7
    language_power: float = 0.7
    topic_power: float = 0.5
    source_targets: Mapping[str, float] | None = None
    language_targets: Mapping[str, float] | None = None
    topic_targets: Mapping[int, float] | None = None
    sources: int | None = None
    languages: int | None = None
    topics: int = 16
    topic_word_bytes: int = 7
    seed: int = 7
    tolerance: float = 1e-9
    rounds: int = 100


def attainable(goal: np.ndarray, held: np.ndarray, wanted: float) -> np.ndarray:
    """Tokens per slice in proportion to ``goal``, ``wanted`` in all; a slice that holds fewer gives all it has."""
    out = np.zeros(len(goal))
    full = (goal <= 0) | (held <= 0)
    while True:
        free = ~full
        rest = wanted - float(out[full].sum())
        if not free.any() or rest <= 0:
            return out
        share = goal[free] / goal[free].sum() * rest
        out[free] = np.minimum(share, held[free])
        short = share > held[free]
        if not short.any():
            return out
        full[np.flatnonzero(free)[short]] = True


def rake(mass: np.ndarray, targets: list[np.ndarray], tolerance: float, rounds: int) -> np.ndarray:
    """Tokens to draw from each cell of ``mass``, no more than it has, so that the marginals are ``targets``.

    Iterative proportional fitting with a bound: axis by axis, each slice is
    scaled until it has its target while its full cells stay full. ``mass`` has
    one axis per target. This is the whole table at once, as ``plan_mixture``
    does it by parts.
    """
    ratio = np.ones_like(mass, dtype=float)
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(targets):
            rows = np.moveaxis(ratio, axis, 0).reshape(len(goal), -1)
            held = np.moveaxis(mass, axis, 0).reshape(len(goal), -1)
            worst = max(worst, float(np.abs(np.minimum(held, held * rows).sum(axis=1) - goal).max()))
            row = np.repeat(np.arange(len(goal)), held.shape[1])
            factor = fill(held.ravel(), rows.ravel(), row, goal)
            ratio = ratio * factor.reshape([-1 if a == axis else 1 for a in range(mass.ndim)])
        if worst <= tolerance * float(mass.sum()):
            break
    return mass * np.minimum(1.0, ratio)


def step(goal: np.ndarray, full: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Factor of each slice toward its goal, given what its full and its other cells hold. Slices that are all full keep 1."""
    rest = np.maximum(goal - full, 0.0)
    down = np.divide(goal, full + free, out=np.ones(len(goal)), where=full + free > 0)
    return np.where(free > 0, np.where(rest > 0, np.divide(rest, free, out=np.ones(len(goal)), where=free > 0), down), np.where(goal < full, down, 1.0))


def fill(mass: np.ndarray, ratio: np.ndarray, row: np.ndarray, goal: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Factor of each row so that its cells, min(mass, mass x factor x ratio), sum to its goal: Newton's steps on a concave sum."""
    factor = np.ones(len(goal))
    for _ in range(rounds):
        now = ratio * factor[row]
        over = now >= 1
        change = step(goal, np.bincount(row, mass * over, len(goal)), np.bincount(row, mass * now * ~over, len(goal)))
        factor = factor * change
        if np.abs(change - 1).max(initial=0.0) < 1e-12:
            break
    return factor


def topics_and_sizes(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its topic: the hash bucket that most of its long words fall in.

    Ties go to the smaller bucket; a text without long words has topic -1.
    """
    w = W.split(data, offsets, lower=True)
    long_words = (w.end - w.start) >= s.topic_word_bytes
    bucket = (w.hash[long_words] % np.uint64(s.topics)).astype(np.int64)
    n = len(offsets) - 1
    votes = np.bincount(w.text[long_words] * s.topics + bucket, minlength=n * s.topics).reshape(n, s.topics)
    return np.diff(w.first), np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), -1)


def label(documents: DataFrame, s: Settings, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and __tokens and __topic of the text."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets):
                n_words, topic = topics_and_sizes(data, offsets[low : high + 1], s)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in keep), pa.array(n_words, pa.int64()), pa.array(topic, pa.int32())],
                    names=[*keep, "__tokens", "__topic"],
                )

    read = documents.select(*dict.fromkeys([*keep, "text"]))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "__tokens long", "__topic int"]))


def _grouped(column: Column, largest: list[str] | None) -> Column:
    known = F.coalesce(column, F.lit(""))
    if largest is None:
        return known
    # A real name that starts with ~ gets another, so that none is REST.
    own = F.when(known.startswith("~"), F.concat(F.lit("~"), known)).otherwise(known)
    return F.when(known.isin(largest), own).otherwise(F.lit(REST)) if largest else F.lit(REST)


def _largest(labelled: DataFrame, column: str, n: int | None) -> list[str] | None:
    if n is None:
        return None
    sums = labelled.groupBy(F.coalesce(column, F.lit("")).alias("name")).agg(F.sum("__tokens").alias("tokens"))
    return [r["name"] for r in sums.orderBy(F.desc("tokens"), "name").limit(n).collect()]


@dataclass(frozen=True)
class Plan:
    """The raked cells: (__s, __l, __topic, __cell_tokens, tokens to draw as __weight, __probability)."""

    sources: list[str] | None
    languages: list[str] | None
    cells: DataFrame
    small: bool

    SCHEMA = "__s string, __l int, __t int, __cell_tokens long, __weight double, __probability double"


def _flat(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per source its goal; per cell its source's row, language, topic and tokens."""
    columns = {c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c) for c in ("goal", "l", "t", "m")}
    counts = columns["m"].value_lengths().to_numpy(zero_copy_only=False)
    cells = [columns[c].flatten().to_numpy(zero_copy_only=False) for c in ("l", "t", "m")]
    return columns["goal"].to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts), *cells


def _drawn(batch: pa.RecordBatch | pa.Table, by_language: np.ndarray, by_topic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, topic, tokens and drawn share of each cell, which may pass 1; sources, whole here, meet their goals."""
    goal, row, l, t, m = _flat(batch)
    ratio = by_language[l] * by_topic[t]
    return l, t, m, ratio * fill(m, ratio, row, goal)[row]


def _sums(packed: DataFrame, local: pa.Table | None, size: int, of: Callable[[pa.RecordBatch | pa.Table], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` over all sources: at the driver over ``local``, else in tasks."""
    if local is not None:
        return of(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "x"])

    out = np.zeros(size)
    for r in packed.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def _weights(names: list, held: np.ndarray, targets: Mapping | None, power: float) -> np.ndarray:
    """Wanted weight of each name."""
    if targets is not None:
        return np.array([float(targets.get(n, 0.0)) for n in names])
    return np.where(held > 0, held, 1.0) ** power * (held > 0)


def _source_goals(packed: DataFrame, s: Settings, wanted: float) -> DataFrame:
    """Column ``goal`` of each source's row: ``attainable`` by sums, for any number of sources."""
    if s.source_targets is None:
        weight = F.when(F.col("total") > 0, F.pow("total", F.lit(s.source_power))).otherwise(F.lit(0.0))
    else:
        listed = packed.sparkSession.createDataFrame([(k or "", float(v)) for k, v in s.source_targets.items()] or [("", 0.0)], "s string, w double")
        packed = packed.join(listed.groupBy("s").agg(F.sum("w").alias("w")), "s", "left")
        weight = F.coalesce("w", F.lit(0.0))
    weighed = packed.withColumn("weight", weight)
    # A source is full once scale x weight passes what it has; the scale grows
    # with each step until no further source fills.
    scale = 0.0
    for _ in range(100):
        over = F.col("weight") * F.lit(scale) >= F.col("total")
        live = F.col("weight") > 0
        full, free = weighed.agg(F.sum(F.when(live & over, F.col("total"))), F.sum(F.when(live & ~over, F.col("weight")))).first()
        fresh = (wanted - (full or 0.0)) / free if free and wanted > (full or 0.0) else scale
        if fresh <= scale * (1 + 1e-15):
            break
        scale = fresh
    return weighed.withColumn("goal", F.least(F.col("weight") * F.lit(scale), F.col("total"))).drop("weight", "w", "total")


def plan_mixture(labelled: DataFrame, s: Settings) -> Plan:
    """Rake the token sums of all of ``labelled(source, lang, __topic, __tokens)``.

    A cell gives no more tokens than it has, and the marginals of what is drawn
    are the targets; where a slice holds less than its target it gives all, and
    the others share the rest. A source's cells are one row. A round scales
    each source to its goal where its row is and sums languages x topics, which
    the driver scales; it holds a factor per language and topic and never one
    per source.
    """
    spark = labelled.sparkSession
    store = Store(spark, "cells")
    sources, languages = _largest(labelled, "source", s.sources), _largest(labelled, "lang", s.languages)
    keys = [_grouped(F.col("source"), sources).alias("s"), _grouped(F.col("lang"), languages).alias("l"), F.col("__topic").alias("t")]
    cells = store.put("cells", labelled.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")))
    pairs = cells.groupBy("l", "t").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    names = sorted({r["l"] for r in pairs})
    number = {name: i for i, name in enumerate(names)}
    mass = np.zeros((len(names), s.topics + 1))
    for r in pairs:
        mass[number[r["l"]], r["t"] + 1] = r["tokens"]
    whole, small = float(mass.sum()), sum(r["n"] for r in pairs) <= LOCAL_CELLS
    wanted = min(1.0, s.fraction) * whole
    numbered = spark.createDataFrame(list(number.items()), "l string, li int")
    one = F.struct(F.col("li").alias("l"), (F.col("t") + 1).alias("t"), F.col("tokens").alias("m"))
    rows = cells.join(F.broadcast(numbered), "l").groupBy("s").agg(F.sort_array(F.collect_list(one)).alias("c"), F.sum("tokens").cast("double").alias("total"))
    rows = rows.select("s", "total", "c.l", "c.t", F.transform("c.m", lambda m: m.cast("double")).alias("m"))
    packed = store.put("packed", _source_goals(store.put("sources", rows), s, wanted))
    by_language, by_topic = np.ones(len(names)), np.ones(s.topics + 1)
    if whole:
        local = packed.toArrow().sort_by("s") if small else None
        targets = (names, s.language_targets, s.language_power), (list(range(-1, s.topics)), s.topic_targets, s.topic_power)
        goals = [attainable(_weights(n, held, t, p), held, wanted) for (n, t, p), held in zip(targets, (mass.sum(axis=1), mass.sum(axis=0)), strict=True)]

        def margins(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
            """What full cells and what the others give, by language and topic."""
            l, t, m, ratio = _drawn(batch, by_language, by_topic)
            over = ratio >= 1
            spot = l.astype(np.int64) * mass.shape[1] + t
            return np.concatenate([np.bincount(spot, x, mass.size) for x in (m * over, m * ratio * ~over)])

        for i in range(2 * s.rounds):
            now = _sums(packed, local, 2 * mass.size, margins).reshape(2, *mass.shape)
            sums = [now.sum(axis=2), now.sum(axis=1)]
            if max(float(np.abs(x.sum(axis=0) - g).max()) for x, g in zip(sums, goals, strict=True)) <= s.tolerance * whole:
                break
            if i % 2:
                by_topic = by_topic * step(goals[1], *sums[1])
            else:
                by_language = by_language * step(goals[0], *sums[0])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            l, t, m, ratio = _drawn(batch, by_language, by_topic)
            odds = np.where(m > 0, np.minimum(1.0, ratio), 0.0)
            name = batch.column("s").take(pa.array(_flat(batch)[1]))
            yield pa.RecordBatch.from_arrays(
                [name, pa.array(l, pa.int32()), pa.array(t - 1, pa.int32()), pa.array(m.astype(np.int64)), pa.array(m * odds), pa.array(odds)],
                names=["__s", "__l", "__t", "__cell_tokens", "__weight", "__probability"],
            )

    raked = packed.mapInArrow(finish, Plan.SCHEMA).withColumnsRenamed({"__l": "li", "__t": "__topic"})
    named = raked.join(F.broadcast(numbered.withColumnRenamed("l", "__l")), "li").drop("li")
    return Plan(sources, languages, store.put("raked", named), small)


def draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that the key and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key.cast("long")), 11).cast("double") / F.lit(float(1 << 53))


def _decide(labelled: DataFrame, plan: Plan, s: Settings) -> DataFrame:
    keyed = labelled.withColumn("__s", _grouped(F.col("source"), plan.sources)).withColumn("__l", _grouped(F.col("lang"), plan.languages))
    joined = keyed.join(F.broadcast(plan.cells) if plan.small else plan.cells, ["__s", "__l", "__topic"])
    return joined.withColumn("__draw", draw(F.col("doc_id"), s.seed)).withColumn("__sampled", F.col("__draw") < F.col("__probability"))


def assign(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Cell, weight, probability, draw and decision of every document.

    A document's size is its number of words; a null or empty text has none
    and topic -1. Null sources and languages count as the empty name. The draw
    depends on doc_id alone, so rows that repeat a doc_id draw alike (a null
    doc_id too). An empty table gives an empty result. A cell without tokens
    has probability 0. Columns other than doc_id, text, source and lang are
    not read.
    """
    store = Store(documents.sparkSession, "mixture")
    labelled = store.put("labels", label(documents, s, ["doc_id", "source", "lang"]))
    found = _decide(labelled, plan_mixture(labelled, s), s)
    return found.select(
        "doc_id",
        F.col("__s").alias("source_group"),
        F.col("__l").alias("language_group"),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"),
        F.col("__draw").alias("draw"),
        F.col("__sampled").alias("sampled"),
    )


def mix(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The sampled documents, all columns, decided as in ``assign``, with its edge cases; columns of any other name pass."""
    return passing(documents, ("doc_id", "text", "source", "lang"), lambda d: _mix(d, s))


def _mix(documents: DataFrame, s: Settings) -> DataFrame:
    labelled = label(documents, s, ["doc_id", "source", "lang"])
    plan = plan_mixture(Store(documents.sparkSession, "mixture").put("labels", labelled), s)
    whole = label(documents, s, documents.columns)
    return _decide(whole, plan, s).filter("__sampled").select(*(f"`{c}`" for c in documents.columns))
