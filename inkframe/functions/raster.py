"""Overlap of a rectangle and a polygon, counted in pixels of a one-bit raster.

A shape is the list of its spans in each pixel row, so nothing is drawn: spans
are cut by the rectangle and their pixels counted. The fill has the edges of
the shape, both ends of a span, and its first and last row. Corners are whole
pixels, fractions cut off. Where an edge ends in a row above the last, it counts
for two crossings, so that the crossings of a row pair up at every corner.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A raster with more pixels than this points to broken input.
MOST_PIXELS = 10_000_000


def row_spans(ring: list[tuple[int, int]], y: int) -> list[tuple[int, int]]:
    """First and last pixel of each span that a polygon of whole corners has in a row."""
    last = max(p[1] for p in ring)
    crossings, spans = [], []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 == y1 == y:
            spans.append((min(x0, x1), max(x0, x1)))
        elif y0 != y1 and min(y0, y1) <= y <= max(y0, y1):
            crossings += [x0 + (y - y0) * (x1 - x0) / (y1 - y0)] * (2 if y == max(y0, y1) < last else 1)
    crossings.sort()
    return spans + [(math.floor(a + 0.5), math.ceil(b - 0.5)) for a, b in zip(crossings[::2], crossings[1::2], strict=False)]


def polygon_mask(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The filled raster of one polygon."""
    out = np.zeros((height, width), bool)
    ring = [(int(x), int(y)) for x, y in points]
    for y in range(height):
        for first, last in row_spans(ring, y):
            out[y, max(0, first) : max(0, last + 1)] = True
    return out


def _region(rect: tuple[float, float, float, float], xs: list[float], ys: list[float]) -> tuple[int, int, int, int]:
    left, top = max(0, math.floor(min(rect[0], *xs))), max(0, math.floor(min(rect[1], *ys)))
    width = max(1, math.ceil(max(rect[2], *xs)) - left + 1)
    height = max(1, math.ceil(max(rect[3], *ys)) - top + 1)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a raster of {width} x {height} pixels is too large")
    return left, top, width, height


def rect_polygon_iom(rect: tuple[float, float, float, float], points: list[tuple[float, float]]) -> float:
    """Common pixels over the smaller number of pixels of one pair, from two rasters; 0 with fewer than three points or without a common box."""
    if len(points) < 3:
        return 0.0
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    if not (rect[0] < max(xs) and min(xs) < rect[2] and rect[1] < max(ys) and min(ys) < rect[3]):
        return 0.0
    left, top, width, height = _region(rect, xs, ys)
    a = np.zeros((height, width), bool)
    a[max(0, int(rect[1] - top)) : max(0, int(rect[3] - top) + 1), max(0, int(rect[0] - left)) : max(0, int(rect[2] - left) + 1)] = True
    b = polygon_mask([(x - left, y - top) for x, y in points], width, height)
    least = min(int(a.sum()), int(b.sum()))
    return float((a & b).sum() / least) if least else 0.0


def _spans(ring: Column, y: Column) -> Column:
    """``row_spans`` of columns, spans in order; ``ring`` is an array of struct x, y of whole numbers."""
    last = F.array_max(F.transform(ring, lambda p: p["y"]))
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    touched = F.filter(edges, lambda e: (F.least(e["y0"], e["y1"]) <= y) & (y <= F.greatest(e["y0"], e["y1"])))
    level = F.filter(touched, lambda e: e["y0"] == e["y1"])
    span = lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last"))
    flat = F.transform(level, lambda e: span(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])))

    def crossing(e: Column) -> Column:
        x = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
        ends = (y == F.greatest(e["y0"], e["y1"])) & (y < last)
        return F.array_repeat(x.cast("double"), F.when(ends, F.lit(2)).otherwise(F.lit(1)))

    cuts = F.array_sort(F.flatten(F.transform(F.filter(touched, lambda e: e["y0"] != e["y1"]), crossing)))
    pairs = F.filter(F.transform(cuts, lambda a, i: F.struct(a.alias("a"), F.get(cuts, i + 1).alias("b"), (i % 2 == 0).alias("opens"))), lambda p: p["opens"] & p["b"].isNotNull())
    return F.array_sort(F.concat(flat, F.transform(pairs, lambda p: span(F.floor(p["a"] + 0.5), F.ceil(p["b"] - 0.5)))))


def _pixels(spans: Column, low: Column, high: Column) -> Column:
    """Pixels from ``low`` to ``high`` that some span covers; spans are in order of their first pixel."""
    start = F.struct((low - 1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, s: Column) -> Column:
        first, last = F.greatest(s["first"], state["end"] + 1), F.least(s["last"], high.cast("long"))
        return F.struct(F.greatest(state["end"], last).alias("end"), (state["n"] + F.greatest(last - first + 1, F.lit(0))).alias("n"))

    return F.aggregate(spans, start, add)["n"]


def raster_iom(x1: Column, y1: Column, x2: Column, y2: Column, polygon: Column) -> Column:
    """``rect_polygon_iom`` of columns; ``polygon`` is an array of struct x, y. Use it behind a test of the bounding boxes.

    The rows of a polygon are folded with built-in functions; a raster of over
    ``MOST_PIXELS`` pixels is an error.
    """
    side = lambda f, name: f(F.transform(polygon, lambda p: p[name].cast("double")))
    px1, py1, px2, py2 = side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, F.floor(F.least(x1, px1))), F.greatest(zero, F.floor(F.least(y1, py1)))
    width = F.greatest(F.lit(1), F.ceil(F.greatest(x2, px2)) - left + 1)
    height = F.greatest(F.lit(1), F.ceil(F.greatest(y2, py2)) - top + 1)

    def measured(at: Column) -> Column:
        """The ratio from one struct of everything above, so that it is computed once."""
        cut = lambda v, low: (v - low).cast("long")
        ring = F.transform(polygon, lambda p: F.struct(cut(p["x"], at["left"]).alias("x"), cut(p["y"], at["top"]).alias("y")))
        rx1, ry1 = F.greatest(cut(x1, at["left"]), zero), F.greatest(cut(y1, at["top"]), zero)
        rx2, ry2 = F.least(cut(x2, at["left"]), at["width"] - 1), F.least(cut(y2, at["top"]), at["height"] - 1)
        low = F.greatest(F.array_min(F.transform(ring, lambda p: p["y"])), zero)
        high = F.least(F.array_max(F.transform(ring, lambda p: p["y"])), at["height"] - 1)
        inner = F.struct(ring.alias("ring"), rx1.alias("rx1"), ry1.alias("ry1"), rx2.alias("rx2"), ry2.alias("ry2"), low.alias("low"), high.alias("high"))
        return F.aggregate(F.array(inner), F.lit(0.0), lambda _, r: ratio(at, r))

    def ratio(at: Column, r: Column) -> Column:
        rows = F.when(r["high"] >= r["low"], F.sequence(r["low"], r["high"])).otherwise(F.array().cast("array<long>"))
        none = F.struct(zero.alias("own"), zero.alias("common"))

        def row(total: Column, y: Column) -> Column:
            inside = (y >= r["ry1"]) & (y <= r["ry2"])
            both = lambda spans: F.struct(
                (total["own"] + _pixels(spans, zero, at["width"] - 1)).alias("own"),
                (total["common"] + F.when(inside, _pixels(spans, r["rx1"], r["rx2"])).otherwise(zero)).alias("common"),
            )
            return F.aggregate(F.array(_spans(r["ring"], y)), none, lambda _, spans: both(spans))

        counted = F.aggregate(rows, none, row)
        area = F.greatest(r["rx2"] - r["rx1"] + 1, zero) * F.greatest(r["ry2"] - r["ry1"] + 1, zero)
        return F.aggregate(F.array(counted), F.lit(0.0), lambda _, c: F.coalesce(c["common"] / F.nullif(F.least(c["own"], area), zero), F.lit(0.0)))

    region = F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))
    found = F.aggregate(F.array(region), F.lit(0.0), lambda _, at: F.when(at["width"] * at["height"] > MOST_PIXELS, F.raise_error(F.lit("a raster is too large")).cast("double")).otherwise(measured(at)))
    apart = (x1 >= px2) | (px1 >= x2) | (y1 >= py2) | (py1 >= y2)
    return F.when(polygon.isNull() | (F.size(polygon) < 3) | apart, F.lit(0.0)).otherwise(found)
