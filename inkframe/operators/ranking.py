"""Ranks, shares, margins, reading order and neighbours in a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalized_rank(group: list[str], value: str, tie: str) -> Column:
    """Ascending rank scaled to 0..1; 0 in a group of one."""
    w = Window.partitionBy(*group)
    return (F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)


def softmax_share(group: list[str], score: Column) -> Column:
    """Share of a score in its group, shifted by the maximum; the sum is 1e-12 at least."""
    w = Window.partitionBy(*group)
    e = F.exp(score - F.max(score).over(w))
    return e / F.greatest(F.sum(e).over(w), F.lit(1e-12))


def top_k(frame: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group with their rank; Spark prunes the window to k rows per task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def diverse_first(frame: DataFrame, group: list[str], structure: list[str], rank: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their place from 1: the best of each structure first, then the rest, both by rank.

    The best row of all is the best of its structure, so it is always first.
    """
    within = F.row_number().over(Window.partitionBy(*group, *structure).orderBy(*rank))
    ranked = frame.withColumn("__again", within > 1)
    order = Window.partitionBy(*group).orderBy("__again", *rank)
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("__again")


def top_margin(frame: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """Best score minus second best of each group; null with one member."""
    best = top_k(frame, group, score, tie, 2)
    one, two = (F.max(F.when(F.col("rank") == r, F.col(score))) for r in (1, 2))
    return best.groupBy(*group).agg((one - two).alias("margin"))


def context(frame: DataFrame, page: str, order: str, value: str) -> DataFrame:
    """Previous and next value on the page, and whether they exist."""
    w = Window.partitionBy(page).orderBy(order)
    number = F.row_number().over(w)
    total = F.count(F.lit(1)).over(Window.partitionBy(page))
    return frame.select(
        page,
        order,
        F.lag(value).over(w).alias("previous"),
        F.col(value).alias("current"),
        F.lead(value).over(w).alias("next"),
        F.array(number > 1, F.lit(True), number < total).alias("mask"),
    )


def recent(frame: DataFrame, page: str, order: str, value: str, accepted: Column, n: int = 5) -> DataFrame:
    """The last n accepted values before each accepted row."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(-n, -1)
    return frame.filter(accepted).withColumn("recent", F.collect_list(value).over(w))


def chunk(group: list[str], order: list[str], n: int) -> Column:
    """Number of the chunk of n consecutive rows that a row is in."""
    return F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / n).cast("long")


def nearest_flag(group: list[str], value: str, tie: str) -> Column:
    """Whether a row is the first with the least value of its group."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(value, tie)) == 1


def body_labels(frame: DataFrame, page: str, cy: Column, cx: Column, key: str) -> DataFrame:
    """Numbers of the bodies of a page: downwards, then right to left, then by id."""
    order = Window.partitionBy(page).orderBy(cy, -cx, key)
    return frame.withColumn("body_number", F.row_number().over(order))


#: Panels whose common height is this share of the lower one stand in one band.
BAND_OVERLAP = 0.35


def panel_bands(frames: list[tuple[int, float, float, float]]) -> list[int]:
    """Order of panels (id, y1, y2, x2): bands downwards, right to left inside a band.

    Panels are taken from the top (right first); each joins the band with which
    it shares most height, if that is enough, and widens it; else it opens one.
    """
    bands: list[tuple[list[float], list[int]]] = []
    by_id = {f[0]: f for f in frames}
    for number, top, bottom, _ in sorted(frames, key=lambda f: (f[1], -f[3])):
        best, most = None, 0.0
        for band in bands:
            (low, high), _ = band
            shared = max(0.0, min(bottom, high) - max(top, low)) / max(1.0, min(max(1.0, bottom - top), high - low))
            if shared >= BAND_OVERLAP and shared > most:
                best, most = band, shared
        if best is None:
            bands.append(([top, bottom], [number]))
        else:
            best[0][:] = [min(best[0][0], top), max(best[0][1], bottom)]
            best[1].append(number)
    bands.sort(key=lambda b: b[0][0])
    return [n for _, members in bands for n in sorted(members, key=lambda m: -by_id[m][3])]


def panel_order(frames: DataFrame, page: str, key: str, y1: str, y2: str, x2: str) -> DataFrame:
    """page, panel and its rank from 0 in reading order, as ``panel_bands`` has it.

    Bands depend on each other, so the panels of a page are folded in the JVM:
    the state is the list of bands and the band (from 1) of each panel so far.
    """
    entry = F.struct(F.col(y1).cast("double").alias("y1"), (-F.col(x2)).cast("double").alias("right"), F.col(key).alias("key"), F.col(y2).cast("double").alias("y2"))
    listed = frames.groupBy(page).agg(F.array_sort(F.collect_list(entry)).alias("f"))
    start = F.struct(F.array().cast("array<struct<low:double,high:double>>").alias("bands"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, f: Column) -> Column:
        def share(b: Column) -> Column:
            common = F.greatest(F.lit(0.0), F.least(f["y2"], b["high"]) - F.greatest(f["y1"], b["low"]))
            return common / F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(1.0), f["y2"] - f["y1"]), b["high"] - b["low"]))

        shares = F.transform(s["bands"], share)
        best = F.array_max(shares)
        fits = F.coalesce(best >= BAND_OVERLAP, F.lit(False))
        place = F.when(fits, F.array_position(shares, best).cast("int")).otherwise(F.size(s["bands"]) + 1)
        wider = lambda b, i: F.when(i + 1 == place, F.struct(F.least(b["low"], f["y1"]).alias("low"), F.greatest(b["high"], f["y2"]).alias("high"))).otherwise(b)
        bands = F.when(fits, F.transform(s["bands"], wider)).otherwise(F.array_append(s["bands"], F.struct(f["y1"].alias("low"), f["y2"].alias("high"))))
        return F.struct(bands.alias("bands"), F.array_append(s["at"], place).alias("at"))

    folded = listed.withColumn("s", F.aggregate("f", start, step))
    each = folded.select(page, "s.bands", F.posexplode(F.arrays_zip("f", F.col("s.at").alias("at"))).alias("place", "z"))
    low = F.get("bands", F.col("z.at") - 1)["low"]
    order = Window.partitionBy(page).orderBy(low, "z.at", "z.f.right", "place")
    return each.select(page, F.col("z.f.key").alias("panel"), (F.row_number().over(order) - 1).cast("long").alias("panel_rank"))


def reading_order(texts: DataFrame, panels: DataFrame, page: str, key: str, cx: Column, cy: Column) -> DataFrame:
    """Number the texts of a page: panels in order, inside right to left, then down; texts without a panel last.

    ``texts`` has a column panel; ``panels`` is the result of ``panel_order``.
    A text without panel sorts by (number of panels + cy), as the protocol has it.
    """
    counts = panels.groupBy(page).agg(F.count(F.lit(1)).alias("__frames"))
    joined = texts.join(panels, [page, "panel"], "left").join(counts, page, "left")
    frames = F.coalesce("__frames", F.lit(0)).cast("double")
    first = F.when(frames == 0, 0.0).when(F.col("panel").isNull(), frames + cy).otherwise(F.coalesce(F.col("panel_rank").cast("double"), frames))
    order = Window.partitionBy(page).orderBy(first, -cx, cy, key)
    return joined.withColumn("reading", F.row_number().over(order)).drop("__frames", "panel_rank")


def simple_reading_order(texts: DataFrame, panels: DataFrame, page: str, key: str, panel_y1: str, panel_x2: str, cx: Column, cy: Column) -> DataFrame:
    """The older order: panel top, panel right side, then right to left and down."""
    order = Window.partitionBy(page).orderBy(F.col(panel_y1).asc_nulls_last(), F.col(panel_x2).desc_nulls_last(), -cx, cy, key)
    return texts.join(panels, [page, "panel"], "left").withColumn("reading", F.row_number().over(order))


def learning_rate(epoch: Column, base: float, warmup: int, epochs: int, least: float = 0.0) -> Column:
    """Linear warm-up, then cosine decay; epochs count from 1."""
    import math

    rising = epoch / F.lit(max(1, warmup)) * base
    done = (epoch - warmup) / F.lit(max(1, epochs - warmup))
    falling = F.lit(least) + (base - least) * 0.5 * (1 + F.cos(F.least(F.lit(1.0), done) * math.pi))
    return F.when(epoch <= warmup, rising).otherwise(falling)


def epochs_since_best(history: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """Epochs after the last one that reaches the best metric (within 1e-12)."""
    best = F.max(metric).over(Window.partitionBy(run))
    last = F.max(F.when(F.col(metric) >= F.col("__best") - 1e-12, F.col(epoch)))
    return history.withColumn("__best", best).groupBy(run).agg((F.max(epoch) - last).alias("epochs_since_best"))


