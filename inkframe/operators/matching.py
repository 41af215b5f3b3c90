"""Page-local joins: panels, spatial pairs, greedy one-to-one matches, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions.geometry import Shape, area, contains_centre, intersection, ordering_area
from inkframe.operators.sampling import range_sums


def spatial_pairs(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Pairs of one page that fulfil a geometric condition.

    The page is the equi key, so this is a sort-merge join with a residual
    predicate; cost is the product of two sides of one page, never of tables.
    """
    joined = left.alias("l").join(right.alias("r"), on)
    return joined.filter(condition)


def assign_panels(boxes: DataFrame, frames: DataFrame, page: str, box_id: str, box: Shape, frame_id: str, frame: Shape, fallback: bool = True) -> DataFrame:
    """page, box_id and panel of every box: the smallest frame with its centre, the first at ties.

    With ``fallback`` a box without such a frame takes the frame that covers
    most of it, if any does; else its panel is null. ``frame_id`` orders frames.
    """
    pairs = boxes.join(frames, page, "left")
    inside = F.coalesce(contains_centre(frame, box), F.lit(False))
    share = intersection(box, frame)
    usable = inside | (share > 0) if fallback else inside
    rank = F.struct(
        (~inside).alias("outside"),
        F.when(inside, ordering_area(frame)).otherwise(-share).cast("double").alias("order"),
        F.col(frame_id).alias("panel"),
    )
    best = F.min(F.when(usable & F.col(frame_id).isNotNull(), rank))
    return pairs.groupBy(page, box_id).agg(best["panel"].alias("panel"))


def greedy_match(pairs: DataFrame, group: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """One-to-one matches per group, taken in ``order``; left and right members are used once.

    The order is folded over the pairs of one group inside the JVM. A group's
    pairs are what one page yields, so the array that is folded stays small.
    """
    kind = dict(pairs.dtypes)
    fields = [c.alias(f"o{i}") for i, c in enumerate(order)]
    entry = F.struct(*fields, F.col(left).alias("l"), F.col(right).alias("r"))
    listed = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("__pairs"))
    state = F.struct(
        F.array().cast(f"array<{kind[left]}>").alias("ls"),
        F.array().cast(f"array<{kind[right]}>").alias("rs"),
    )

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["ls"], p["l"]) & ~F.array_contains(s["rs"], p["r"])
        return F.when(free, F.struct(F.array_append(s["ls"], p["l"]).alias("ls"), F.array_append(s["rs"], p["r"]).alias("rs"))).otherwise(s)

    folded = listed.select(*group, F.aggregate("__pairs", state, step).alias("__s"))
    zipped = folded.select(*group, F.explode(F.arrays_zip(F.col("__s.ls").alias("l"), F.col("__s.rs").alias("r"))).alias("__z"))
    return zipped.select(*group, F.col("__z.l").alias(left), F.col("__z.r").alias(right))


def leftovers(rows: DataFrame, consumed: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no match consumed."""
    return rows.join(consumed, on, "left_anti")


def best_match(left: DataFrame, right: DataFrame, page: str, left_id: str, right_id: str, score: Column, order: str, least: float) -> DataFrame:
    """For every left row the right row of its page with the greatest score, the first at ties.

    Several left rows may have the same match; a match under ``least`` is null,
    its score is kept. A page without right rows gives score 0.
    """
    pairs = left.join(right, page, "left")
    value = F.coalesce(score, F.lit(0.0))
    best = F.max(F.struct(value.alias("score"), (-F.col(order)).alias("o"), F.col(right_id).alias("id")))
    found = pairs.groupBy(page, left_id).agg(best.alias("__b"))
    accepted = F.col("__b.score") >= least
    return found.select(page, left_id, F.when(accepted, F.col("__b.id")).alias(right_id), F.col("__b.score").alias("score"))


def concat_lines(boxes: DataFrame, lines: DataFrame, page: str, box_id: str, box: Shape, line: Shape, text: str, least: float = 0.35) -> DataFrame:
    """The text in each box: lines whose centre is inside or that are covered enough, right to left, then down."""
    covered = intersection(line, box) / F.greatest(area(line), F.lit(1)) >= F.lit(least)
    inside = F.coalesce(contains_centre(box, line) | covered, F.lit(False))
    entry = F.struct((-(line.x1 + line.x2)).alias("x"), (line.y1 + line.y2).alias("y"), F.col(text).alias("t"))
    joined = boxes.join(lines, page, "left").groupBy(page, box_id)
    listed = joined.agg(F.array_sort(F.collect_list(F.when(inside, entry))).alias("__l"))
    return listed.select(page, box_id, F.array_join(F.transform("__l", lambda e: e["t"]), "").alias("text"))


def outer_pages(first: DataFrame, second: DataFrame, page: str, item: str) -> DataFrame:
    """Every page of either source with the sorted items of both; a side without the page is an empty list."""
    kind = dict(first.dtypes)[item]
    listed = lambda f, name: f.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias(name))
    joined = listed(first, "first").join(listed(second, "second"), page, "full")
    return joined.select(page, *(F.coalesce(side, F.array().cast(f"array<{kind}>")).alias(side) for side in ("first", "second")))


def inject(rows: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Replace the rows of one source by others; running it twice changes nothing."""
    return rows.filter(~F.col("source").eqNullSafe(F.lit(source))).unionByName(fresh.withColumn("source", F.lit(source)), allowMissingColumns=True)


def regroup(rows: DataFrame, sizes: DataFrame, group: str, position: str) -> DataFrame:
    """Give consecutive rows to groups of given sizes: row n belongs to the group whose range holds n.

    ``sizes(group, n)`` has ascending groups; rows are numbered from 0 in
    ``position``. Ranges are built from the sizes alone and exploded, so rows
    are joined by equality.
    """
    starts = range_sums(sizes.filter("n > 0"), group, "n", "__first").withColumn("__first", F.col("__first").cast("long"))
    owner = starts.select(group, F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("n") - 1)).alias(position))
    return rows.join(owner, position)
