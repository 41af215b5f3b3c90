"""Box, polygon and ray expressions; all arguments and results are columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Shape:
    """What follows from the four columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2


@dataclass(frozen=True)
class Box(Shape):
    """Four columns of a box in page coordinates."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> "Named":
        """Columns ``<prefix>x1`` to ``<prefix>y2``."""
        return Named(prefix)

    @classmethod
    def field(cls, column: str | Column) -> "Box":
        """The fields of a struct column."""
        c = F.col(column) if isinstance(column, str) else column
        return cls(c["x1"], c["y1"], c["x2"], c["y2"])


@dataclass(frozen=True)
class Named(Shape):
    """A box of columns with a common prefix; usable before there is a session."""

    prefix: str

    x1 = property(lambda self: F.col(self.prefix + "x1"))
    y1 = property(lambda self: F.col(self.prefix + "y1"))
    x2 = property(lambda self: F.col(self.prefix + "x2"))
    y2 = property(lambda self: F.col(self.prefix + "y2"))


def _zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def area(b: Shape) -> Column:
    """Width times height, each at least 0."""
    return _zero(b.width) * _zero(b.height)


def ordering_area(b: Shape) -> Column:
    """Width times height, each at least 1; for sorting boxes."""
    return F.greatest(b.width, F.lit(1)) * F.greatest(b.height, F.lit(1))


def overlap_width(a: Shape, b: Shape) -> Column:
    return _zero(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))


def overlap_height(a: Shape, b: Shape) -> Column:
    return _zero(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def intersection(a: Shape, b: Shape) -> Column:
    """Area of the common part."""
    return overlap_width(a, b) * overlap_height(a, b)


def iom(a: Shape, b: Shape) -> Column:
    """Common area over the smaller area; 0 if that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def iou(a: Shape, b: Shape) -> Column:
    """Common area over the joint area, which counts as 1 at least."""
    common = intersection(a, b)
    return common / F.greatest(area(a) + area(b) - common, F.lit(1))


def coverage(line: Shape, box: Shape) -> Column:
    """Share of the line's area (1 at least) that the box covers."""
    return intersection(line, box) / F.greatest(area(line), F.lit(1))


def overlaps(a: Shape, b: Shape) -> Column:
    """Whether the insides meet; touching edges do not count."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def contains_point(b: Shape, x: Column, y: Column) -> Column:
    """Whether a point is inside or on the edge."""
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def contains_centre(outer: Shape, inner: Shape) -> Column:
    """Whether the centre of ``inner`` is in ``outer``; on doubled coordinates, so exact for integers."""
    x, y = inner.x1 + inner.x2, inner.y1 + inner.y2
    return x.between(2 * outer.x1, 2 * outer.x2) & y.between(2 * outer.y1, 2 * outer.y2)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt((x * x + y * y).cast("double"))


def point_distance(x: Column, y: Column, b: Shape) -> Column:
    """Distance of a point from a box, 0 inside."""
    return hypot(F.greatest(b.x1 - x, F.lit(0), x - b.x2), F.greatest(b.y1 - y, F.lit(0), y - b.y2))


def gap_distance(a: Shape, b: Shape) -> Column:
    """Distance between two boxes, 0 if they meet."""
    return hypot(
        F.greatest(a.x1 - b.x2, b.x1 - a.x2, F.lit(0)),
        F.greatest(a.y1 - b.y2, b.y1 - a.y2, F.lit(0)),
    )


def relative_centre_distance(face: Shape, body: Shape) -> Column:
    """Distance of the centres in units of the body's diagonal (1 at least)."""
    return hypot(face.cx - body.cx, face.cy - body.cy) / F.greatest(hypot(body.width, body.height), F.lit(1.0))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def rectangle(b: Shape) -> Column:
    """Corners clockwise from the top left."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(b.x1, b.y1), corner(b.x2, b.y1), corner(b.x2, b.y2), corner(b.x1, b.y2))


def polygon_bounds(points: Column) -> Column:
    """The box around a polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def polygon_area(points: Column) -> Column:
    """Shoelace area; 0 with fewer than three points."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))


def clean_polygon(points: Column, width: Column, height: Column) -> Column:
    """Half-even rounding, clamping to the page, then dropping repeats, also of the first point at the end."""
    whole = lambda v, size: clamp(F.rint(v).cast("long"), F.lit(0).cast("long"), size.cast("long") - 1)
    rounded = F.transform(points, lambda p: F.struct(whole(p["x"], width).alias("x"), whole(p["y"], height).alias("y")))
    previous = F.concat(F.array(F.lit(None).cast("struct<x:bigint,y:bigint>")), rounded)
    marked = F.filter(F.arrays_zip(rounded.alias("p"), F.slice(previous, 1, F.size(rounded)).alias("q")), lambda z: ~z["p"].eqNullSafe(z["q"]))
    kept = F.transform(marked, lambda z: z["p"])
    closed = (F.size(kept) > 1) & (F.element_at(kept, 1) == F.element_at(kept, -1))
    return F.when(closed, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def orientation(w: Column, h: Column) -> Column:
    """vertical from h/w = 1.5, horizontal to 1/1.5, else square; invalid without two positive sides."""
    valid = F.coalesce((w > 0) & (h > 0), F.lit(False))
    return (
        F.when(~valid, "invalid").when(2 * h >= 3 * w, "vertical").when(3 * h <= 2 * w, "horizontal").otherwise("square")
    )


def rescale(b: Shape, sx: Column, sy: Column, width: Column, height: Column) -> Box:
    """Scale a box and clamp it to a grid."""
    return Box(clamp(b.x1 * sx, 0.0, width), clamp(b.y1 * sy, 0.0, height), clamp(b.x2 * sx, 0.0, width), clamp(b.y2 * sy, 0.0, height))


def union_crop(face: Shape, body: Shape, padding: float, width: Column, height: Column) -> Box:
    """The box around both (nulls skipped), padded by a share of its sides, inside the page."""
    x1, y1 = F.least(face.x1, body.x1), F.least(face.y1, body.y1)
    x2, y2 = F.greatest(face.x2, body.x2), F.greatest(face.y2, body.y2)
    px, py = F.rint((x2 - x1) * F.lit(padding)).cast("long"), F.rint((y2 - y1) * F.lit(padding)).cast("long")
    return Box(_zero(x1 - px), _zero(y1 - py), F.least(width, x2 + px), F.least(height, y2 + py))


def crop_bounds(b: Shape, padding: int, width: Column, height: Column) -> Box:
    """A box with absolute padding inside the page, at least one pixel wide and high."""
    x1, y1 = clamp(F.floor(b.x1) - padding, F.lit(0), width - 1), clamp(F.floor(b.y1) - padding, F.lit(0), height - 1)
    return Box(
        x1,
        y1,
        F.greatest(x1 + 1, F.least(width, F.ceil(b.x2) + padding)),
        F.greatest(y1 + 1, F.least(height, F.ceil(b.y2) + padding)),
    )


def clip_detection(b: Shape, width: Column, height: Column) -> Box:
    """A detection clipped to the page with its corners in order."""
    xa, xb = clamp(b.x1, F.lit(0), width), clamp(b.x2, F.lit(0), width)
    ya, yb = clamp(b.y1, F.lit(0), height), clamp(b.y2, F.lit(0), height)
    return Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def fit_dimensions(width: Column, height: Column, long_side: int, patch: int) -> Column:
    """Size after scaling the long side to ``long_side``, and padded up to whole patches."""
    scale = F.lit(float(long_side)) / F.greatest(width, height)
    w, h = F.greatest(F.lit(1), F.rint(width * scale).cast("long")), F.greatest(F.lit(1), F.rint(height * scale).cast("long"))
    up = lambda v: (F.ceil(v / patch) * patch).cast("long")
    return F.struct(w.alias("width"), h.alias("height"), up(w).alias("padded_width"), up(h).alias("padded_height"))


INFINITY = float("inf")


def tail_segment(tail: Shape, text: Shape) -> Column:
    """Root and tip of a speech tail: the ray from the text's centre through the tail, cut at the tail's box.

    A tail with the text's own centre has no direction: both are that centre.
    """
    dx, dy = tail.cx - text.cx, tail.cy - text.cy
    length = F.greatest(hypot(dx, dy), F.lit(1e-6))
    ux, uy = dx / length, dy / length
    half = lambda side: F.greatest(side / 2, F.lit(0.5))
    reach = lambda h, u: F.when(F.abs(u) > 1e-9, h / F.abs(u))
    extent = F.coalesce(F.least(reach(half(tail.width), ux), reach(half(tail.height), uy)), F.lit(0.0))
    return F.struct(
        (tail.cx - ux * extent).alias("root_x"),
        (tail.cy - uy * extent).alias("root_y"),
        (tail.cx + ux * extent).alias("tip_x"),
        (tail.cy + uy * extent).alias("tip_y"),
    )


def diagonal_segments(tail: Shape, text: Shape) -> Column:
    """Both diagonals of a tail's box, oriented away from the text, best aligned first."""
    dx, dy = tail.cx - text.cx, tail.cy - text.cy
    found = []
    for n, (ax, ay, bx, by) in enumerate(((tail.x1, tail.y1, tail.x2, tail.y2), (tail.x1, tail.y2, tail.x2, tail.y1))):
        near_a = hypot(ax - text.cx, ay - text.cy) <= hypot(bx - text.cx, by - text.cy)
        rx, ry, tx, ty = (F.when(near_a, p).otherwise(q).cast("double") for p, q in ((ax, bx), (ay, by), (bx, ax), (by, ay)))
        norm = F.greatest(hypot(tx - rx, ty - ry) * hypot(dx, dy), F.lit(1e-9))
        cosine = ((tx - rx) * dx + (ty - ry) * dy) / norm
        found.append(
            F.struct(
                (-cosine).alias("order"), F.lit(n).alias("diagonal"), cosine.alias("cosine"), rx.alias("root_x"), ry.alias("root_y"), tx.alias("tip_x"), ty.alias("tip_y")
            )
        )
    return F.array_sort(F.array(*found))


def ray_interval(ox: Column, oy: Column, dx: Column, dy: Column, b: Shape) -> Column:
    """The parameters from 0 on at which a ray enters and leaves a box, as struct(enter, leave); null if it misses.

    A direction component under 1e-9 is parallel: the origin must lie between
    the two edges.
    """

    def slab(o: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
        flat = F.abs(d) < 1e-9
        one, two = F.when(~flat, (low - o) / d), F.when(~flat, (high - o) / d)
        inside = ~flat | ((o >= low) & (o <= high))
        return F.coalesce(F.least(one, two), F.lit(0.0)), F.coalesce(F.greatest(one, two), F.lit(INFINITY)), inside

    x_in, x_out, x_ok = slab(ox, dx, b.x1, b.x2)
    y_in, y_out, y_ok = slab(oy, dy, b.y1, b.y2)
    enter, leave = F.greatest(F.lit(0.0), x_in, y_in), F.least(x_out, y_out)
    return F.when(x_ok & y_ok & (leave >= enter), F.struct(enter.alias("enter"), leave.alias("leave")))


def ray_hit(ox: Column, oy: Column, dx: Column, dy: Column, b: Shape) -> Column:
    """The first parameter t >= 0 at which a ray is in a box, 0 from inside; null if it misses."""
    return ray_interval(ox, oy, dx, dy, b)["enter"]


def ray_exit(ox: Column, oy: Column, dx: Column, dy: Column, b: Shape) -> Column:
    """The parameter at which a ray from inside leaves a box; 0 if it does not."""
    sides = []
    for o, d, low, high in ((ox, dx, b.x1, b.x2), (oy, dy, b.y1, b.y2)):
        sides += [F.when(d > 1e-9, (high - o) / d), F.when(d < -1e-9, (low - o) / d)]
    positive = F.filter(F.array(*(s.cast("double") for s in sides)), lambda t: t >= 0)
    return F.coalesce(F.array_min(positive), F.lit(0.0))
