"""Queries over page regions: geometry, joins, matching and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import geometry as G
from inkframe.functions.geometry import Box
from inkframe.operators import graph, matching, metrics, ranking
from inkframe.plans import fixtures as X
from inkframe.plans.registry import query
from inkframe.session import table

R, E = X.REGION_SQL, X.EDGE_SQL
T, B = Box.of("t_"), Box.of("b_")


def _pairs(spark: SparkSession, folder: str, left: str = "text", right: str = "body") -> DataFrame:
    frame = X.regions(spark, folder)
    return X.of_class(frame, left, "t").join(X.of_class(frame, right, "b"), "page_id")


def _pair_sql(left: str = "text", right: str = "body") -> str:
    cols = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "tb" for c in ("region_id", "x1", "y1", "x2", "y2", "w", "h", "part_key", "supp_key"))
    return f"{R},\npair AS (SELECT t.page_id, {cols} FROM region t JOIN region b ON t.page_id = b.page_id AND t.cls = '{left}' AND b.cls = '{right}')"


IW = "greatest(0, least(t_x2, b_x2) - greatest(t_x1, b_x1))"
IH = "greatest(0, least(t_y2, b_y2) - greatest(t_y1, b_y1))"
MEET = "(t_x1 < b_x2 AND b_x1 < t_x2 AND t_y1 < b_y2 AND b_y1 < t_y2)"


@query(
    f"""WITH {E}
SELECT page_id, query, candidate, CAST(score AS BIGINT) AS score, rank, round(share, 6) AS share, CAST(margin AS BIGINT) AS margin FROM (
  SELECT *, exp((score - m) / 1e6) / greatest(sum(exp((score - m) / 1e6)) OVER (PARTITION BY page_id, query), 1e-12) AS share,
    row_number() OVER w AS rank,
    CASE WHEN n > 1 THEN max(CASE WHEN rn = 1 THEN score END) OVER (PARTITION BY page_id, query) - max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY page_id, query) END AS margin
  FROM (SELECT *, max(score) OVER (PARTITION BY page_id, query) AS m, count(*) OVER (PARTITION BY page_id, query) AS n,
          row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS rn FROM edge)
  WINDOW w AS (PARTITION BY page_id, query ORDER BY score DESC, candidate)
) WHERE rank <= 3"""
)
def speaker_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest bodies of each text with share and margin."""
    group = ["page_id", "query"]
    edges = X.edges(spark, folder).select("page_id", "query", "candidate", "score")
    shared = edges.withColumn("share", ranking.softmax_share(group, F.col("score") / 1e6))
    best = ranking.top_k(shared, group, "score", "candidate", 3)
    w = ranking.Window.partitionBy(*group).orderBy("rank")
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(ranking.Window.partitionBy(*group))
    return best.withColumn("margin", F.first("score").over(w) - second)


@query(
    f"""WITH {_pair_sql()}
SELECT page_id, t_region_id AS text_id, b_region_id AS body_id, CAST({IW} * {IH} AS BIGINT) AS inter,
  round({IW} * {IH} / least(t_w * t_h, b_w * b_h), 9) AS iom,
  round({IW} * {IH} / greatest(t_w * t_h + b_w * b_h - {IW} * {IH}, 1), 9) AS iou
FROM pair WHERE {MEET}""",
    digits=9,
)
def iom_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """F5 (bounding boxes), D3, D4, D5, D6, D8: overlapping text and body pairs."""
    pairs = _pairs(spark, folder).filter(G.overlaps(T, B))
    return pairs.select(
        "page_id", F.col("t_region_id").alias("text_id"), F.col("b_region_id").alias("body_id"), G.intersection(T, B).alias("inter"), G.iom(T, B).alias("iom"), G.iou(T, B).alias("iou")
    )


@query(
    f"""WITH {_pair_sql("text", "frame")}
SELECT page_id, t_region_id AS text_id, b_region_id AS frame_id,
  round(sqrt(CAST(power(greatest(b_x1 - (t_x1 + t_x2) / 2.0, 0, (t_x1 + t_x2) / 2.0 - b_x2), 2) + power(greatest(b_y1 - (t_y1 + t_y2) / 2.0, 0, (t_y1 + t_y2) / 2.0 - b_y2), 2) AS DOUBLE)), 6) AS point_gap,
  round(sqrt(CAST(power(greatest(t_x1 - b_x2, b_x1 - t_x2, 0), 2) + power(greatest(t_y1 - b_y2, b_y1 - t_y2, 0), 2) AS DOUBLE)), 6) AS box_gap,
  (t_x1 + t_x2) / 2.0 BETWEEN b_x1 AND b_x2 AND (t_y1 + t_y2) / 2.0 BETWEEN b_y1 AND b_y2 AS centre_inside,
  round({IW} * {IH} / greatest(t_w * t_h, 1), 6) AS coverage
FROM pair"""
)
def box_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between texts and frames."""
    return _pairs(spark, folder, "text", "frame").select(
        "page_id",
        F.col("t_region_id").alias("text_id"),
        F.col("b_region_id").alias("frame_id"),
        G.point_distance(T.cx, T.cy, B).alias("point_gap"),
        G.gap_distance(T, B).alias("box_gap"),
        G.contains_point(B, T.cx, T.cy).alias("centre_inside"),
        G.coverage(T, B).alias("coverage"),
    )


@query(
    f"""WITH {R}
SELECT cls, CASE WHEN 2 * h >= 3 * w THEN 'vertical' WHEN 3 * h <= 2 * w THEN 'horizontal' ELSE 'square' END AS orientation, count(*) AS n,
  CAST(sum(greatest(w, 1) * greatest(h, 1)) AS BIGINT) AS area
FROM region GROUP BY ALL"""
)
def orientation_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Orientation of boxes by class."""
    frame = X.regions(spark, folder).withColumn("orientation", G.orientation(F.col("w"), F.col("h")))
    return frame.groupBy("cls", "orientation").agg(F.count(F.lit(1)).alias("n"), F.sum(G.ordering_area(Box.of())).alias("area"))


@query(
    f"""WITH {R}
SELECT region_id, CAST(greatest(0, least(1000, x1 - 10)) AS BIGINT) AS crop_x1, CAST(greatest(0, least(1400, y1 - 10)) AS BIGINT) AS crop_y1,
  CAST(greatest(greatest(0, least(1000, x1 - 10)) + 1, least(1001, x2 + 10)) AS BIGINT) AS crop_x2,
  CAST(greatest(greatest(0, least(1400, y1 - 10)) + 1, least(1401, y2 + 10)) AS BIGINT) AS crop_y2,
  CAST(w * h AS DOUBLE) AS polygon_area, CAST(x1 AS DOUBLE) AS bx1, CAST(y2 AS DOUBLE) AS by2,
  round(least(x1 * 0.25, 250.0), 6) AS grid_x1, round(least(y2 * 0.5, 500.0), 6) AS grid_y2
FROM region"""
)
def crops_and_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Crop bounds, polygon of a box and back, grid boxes."""
    box = Box.of()
    crop = G.crop_bounds(box, 10, F.lit(1001), F.lit(1401))
    grid = G.rescale(box, F.lit(0.25), F.lit(0.5), F.lit(250.0), F.lit(500.0))
    points = X.regions(spark, folder).withColumn("polygon", G.rectangle(box)).withColumn("b", G.polygon_bounds(F.col("polygon")))
    return points.select(
        "region_id",
        *(getattr(crop, c).cast("long").alias(f"crop_{c}") for c in ("x1", "y1", "x2", "y2")),
        G.polygon_area(F.col("polygon")).alias("polygon_area"),
        F.col("b.x1").alias("bx1"),
        F.col("b.y2").alias("by2"),
        grid.x1.alias("grid_x1"),
        grid.y2.alias("grid_y2"),
    )


@query(
    f"""WITH {R}
SELECT region_id, len(kept) AS corners, CAST(list_sum(list_transform(kept, lambda p: p.x)) AS BIGINT) AS sum_x, CAST(list_sum(list_transform(kept, lambda p: p.y)) AS BIGINT) AS sum_y FROM (
  SELECT region_id, CASE WHEN len(u) > 1 AND u[1] = u[len(u)] THEN u[1:len(u) - 1] ELSE u END AS kept FROM (
    SELECT region_id, list_filter(pts, lambda p, i: i = 1 OR p <> pts[i - 1]) AS u FROM (
      SELECT region_id, [{{'x': least(999, x1), 'y': least(1399, y1)}}, {{'x': least(999, x2), 'y': least(1399, y1)}}, {{'x': least(999, x2), 'y': least(1399, y2)}},
        {{'x': least(999, x1), 'y': least(1399, y2)}}, {{'x': least(999, x1), 'y': least(1399, y1)}}] AS pts FROM region)))"""
)
def clean_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding, clamping and dropping repeated corners of closed polygons."""
    corners = G.rectangle(Box.of())
    closed = F.concat(corners, F.slice(corners, 1, 1))
    rows = X.regions(spark, folder).select("region_id", G.clean_polygon(closed, F.lit(1000), F.lit(1400)).alias("kept"))
    total = lambda field: F.aggregate(F.transform("kept", lambda p: p[field]), F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select("region_id", F.size("kept").alias("corners"), total("x").alias("sum_x"), total("y").alias("sum_y"))


PANEL_SQL = """
panel AS (
  SELECT page_id, region_id, panel FROM (
    SELECT t.page_id, t.region_id, CASE WHEN inside OR inter > 0 THEN f_id END AS panel,
      row_number() OVER (PARTITION BY t.page_id, t.region_id ORDER BY CASE WHEN inside THEN 0 WHEN inter > 0 THEN 1 ELSE 2 END, CASE WHEN inside THEN f_area WHEN inter > 0 THEN -inter END, f_id) AS rn
    FROM (
      SELECT t.page_id, t.region_id, f.region_id AS f_id, f.w * f.h AS f_area,
        coalesce((t.x1 + t.x2) BETWEEN 2 * f.x1 AND 2 * f.x2 AND (t.y1 + t.y2) BETWEEN 2 * f.y1 AND 2 * f.y2, false) AS inside,
        coalesce(greatest(0, least(t.x2, f.x2) - greatest(t.x1, f.x1)) * greatest(0, least(t.y2, f.y2) - greatest(t.y1, f.y1)), 0) AS inter
      FROM region t LEFT JOIN region f ON t.page_id = f.page_id AND f.cls = 'frame' WHERE t.cls <> 'frame'
    ) t
  ) WHERE rn = 1
)"""


def panels_of(regions: DataFrame, fallback: bool = True) -> DataFrame:
    """page_id, region_id and panel of every region that is no frame."""
    frames = regions.filter("cls = 'frame'").select("page_id", F.col("region_id").alias("f_id"), *(F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")))
    boxes = regions.filter("cls <> 'frame'").select("page_id", "region_id", "x1", "y1", "x2", "y2")
    return matching.assign_panels(boxes, frames, "page_id", "region_id", Box.of(), "f_id", Box.of("f_"), fallback)


def frames_of(regions: DataFrame, name: str) -> DataFrame:
    """page_id, the frame's id under ``name``, and its box as p_x1 to p_y2."""
    frames = regions.filter("cls = 'frame'")
    return frames.select("page_id", F.col("region_id").alias(name), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))


@query(f"WITH {R}, {PANEL_SQL} SELECT page_id, region_id, panel FROM panel")
def panel_assign(spark: SparkSession, folder: str) -> DataFrame:
    """F8: the panel of every region, by centre or else by overlap."""
    return panels_of(X.regions(spark, folder))


@query(
    f"""WITH {R}
SELECT t.page_id, t.region_id, min(f.rk)[2] AS panel FROM region t LEFT JOIN (
  SELECT page_id, x1, y1, x2, y2, [w * h, region_id] AS rk FROM region WHERE cls = 'frame') f
ON t.page_id = f.page_id AND (t.x1 + t.x2) BETWEEN 2 * f.x1 AND 2 * f.x2 AND (t.y1 + t.y2) BETWEEN 2 * f.y1 AND 2 * f.y2
WHERE t.cls <> 'frame' GROUP BY t.page_id, t.region_id"""
)
def panel_by_centre(spark: SparkSession, folder: str) -> DataFrame:
    """the smallest frame that has the centre, or none."""
    return panels_of(X.regions(spark, folder), fallback=False)


@query(
    f"""WITH {R}, {PANEL_SQL}
SELECT page_id, query, candidate, distance_rank, is_nearest, same_panel, same_count, candidates FROM (
  SELECT e.page_id, e.query, e.candidate, round((row_number() OVER w - 1) / greatest(1, count(*) OVER g - 1), 6) AS distance_rank, row_number() OVER w = 1 AS is_nearest,
    coalesce(pt.panel = pb.panel, false) AS same_panel, CAST(sum(CASE WHEN pt.panel = pb.panel THEN 1 ELSE 0 END) OVER g AS BIGINT) AS same_count, count(*) OVER g AS candidates
  FROM (SELECT t.page_id, t.region_id AS query, b.region_id AS candidate,
     ((t.x1 + t.x2) - (b.x1 + b.x2)) * ((t.x1 + t.x2) - (b.x1 + b.x2)) + ((t.y1 + t.y2) - (b.y1 + b.y2)) * ((t.y1 + t.y2) - (b.y1 + b.y2)) AS d
     FROM region t JOIN region b ON t.page_id = b.page_id AND t.cls = 'text' AND b.cls = 'body') e
  JOIN panel pt ON pt.region_id = e.query JOIN panel pb ON pb.region_id = e.candidate
  WINDOW w AS (PARTITION BY e.page_id, e.query ORDER BY d, e.candidate), g AS (PARTITION BY e.page_id, e.query))"""
)
def rank_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Distance ranks, nearest flags and counts of each text's candidates."""
    frame = X.regions(spark, folder)
    panel = panels_of(frame)
    edges = X.edges(spark, folder).select("page_id", "query", "candidate", (-F.col("score")).alias("d"))
    joined = edges.join(panel.withColumnsRenamed({"region_id": "query", "panel": "pt"}), ["page_id", "query"]).join(
        panel.withColumnsRenamed({"region_id": "candidate", "panel": "pb"}), ["page_id", "candidate"]
    )
    group = ["page_id", "query"]
    w = ranking.Window.partitionBy(*group)
    same = F.coalesce(F.col("pt") == F.col("pb"), F.lit(False))
    return joined.select(
        *group,
        "candidate",
        ranking.normalized_rank(group, "d", "candidate").alias("distance_rank"),
        ranking.nearest_flag(group, "d", "candidate").alias("is_nearest"),
        same.alias("same_panel"),
        F.count_if(same).over(w).alias("same_count"),
        F.count(F.lit(1)).over(w).alias("candidates"),
    )


def _page_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Text-body pairs (t_*, b_*) with their panels pt and pb and the text's panel as p_*.

    The frames of a page are listed once; every box of the page finds its panel
    in that list, and brings the panel's box along. Texts then meet the bodies
    of their page. All of it is dealt by page, so nothing is shuffled again.
    """
    sides = ("x1", "y1", "x2", "y2")
    regions = X.regions(spark, folder)
    frames = regions.filter("cls = 'frame'").groupBy("page_id").agg(F.collect_list(F.struct("region_id", *sides)).alias("frames"))
    own = Box.of()

    def rank(f: Column) -> Column:
        inside = G.contains_centre(Box.field(f), own)
        order = F.when(inside, G.ordering_area(Box.field(f))).otherwise(-G.intersection(own, Box.field(f))).cast("double")
        return F.struct((~inside).alias("outside"), order.alias("order"), f["region_id"].alias("panel"), *(f[c].alias(c) for c in sides))

    usable = lambda f: G.contains_centre(Box.field(f), own) | (G.intersection(own, Box.field(f)) > 0)
    boxes = regions.filter("cls IN ('text', 'body')").select("page_id", "cls", "region_id", *sides).join(frames, "page_id", "left")
    boxes = boxes.withColumn("p", F.array_min(F.transform(F.filter("frames", usable), rank))).drop("frames")
    side = lambda cls, prefix, *more: boxes.filter(F.col("cls") == cls).select("page_id", *(F.col(c).alias(f"{prefix}_{c}") for c in ("region_id", *sides)), F.col("p.panel").alias(f"p{prefix}"), *more)
    return side("text", "t", *(F.col(f"p.{c}").alias(f"p_{c}") for c in sides)).join(side("body", "b"), "page_id")


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, list[Column]]:
    """Pairs of texts and bodies, and the 45 features over them in their fixed order."""
    pairs = _page_pairs(spark, folder)
    group = ["page_id", "t_region_id"]
    one = F.lit(1.0)
    # Doubled coordinates keep the ranked distance a whole number.
    dx2, dy2 = (T.x1 + T.x2) - (B.x1 + B.x2), (T.y1 + T.y2) - (B.y1 + B.y2)
    same = F.coalesce(F.col("pt") == F.col("pb"), F.lit(False))
    w = ranking.Window.partitionBy(*group)
    by_distance = w.orderBy("__d", "b_region_id")
    ranked = pairs.withColumns({"__d": dx2 * dx2 + dy2 * dy2, "__same": same})
    ranked = ranked.withColumns(
        {
            "__n": F.count(F.lit(1)).over(w),
            "__ns": F.count_if("__same").over(w),
            "__r": F.row_number().over(by_distance),
            "__rs": F.count_if("__same").over(by_distance),  # the rank among those of the panel, for rows of the panel
        }
    )
    width, height = F.lit(float(X.PAGE_WIDTH)), F.lit(float(X.PAGE_HEIGHT))
    page_area, diagonal = width * height, F.sqrt(width * width + height * height)
    at, ab = G.ordering_area(T).cast("double"), G.ordering_area(B).cast("double")
    dx, dy = B.cx - T.cx, B.cy - T.cy
    distance = G.hypot(dx, dy)
    gx, gy = F.greatest(F.lit(0), T.x1 - B.x2, B.x1 - T.x2), F.greatest(F.lit(0), T.y1 - B.y2, B.y1 - T.y2)
    iw, ih = G.overlap_width(T, B), G.overlap_height(T, B)
    inter = iw * ih
    P = Box.of("p_")
    pw, ph = F.greatest(P.width, one), F.greatest(P.height, one)
    inside = lambda v: F.when(F.col("__same"), v).otherwise(F.lit(0.0))
    flag = lambda c: c.cast("double")
    side = lambda v: F.greatest(v, one)
    features = [
        T.cx / width, T.cy / height, T.width / width, T.height / height, at / page_area,
        B.cx / width, B.cy / height, B.width / width, B.height / height, ab / page_area,
        dx / width, dy / height, F.abs(dx / width), F.abs(dy / height), distance / diagonal,
        gx / width, gy / height, G.hypot(gx, gy) / diagonal,
        inter / side(at + ab - inter), inter / side(at), inter / side(ab),
        iw / side(T.width), iw / side(B.width), ih / side(T.height), ih / side(B.height),
        F.log(side(ab) / side(at)),
        flag(F.col("__same")), flag(F.col("pt").isNotNull()), flag(F.col("pb").isNotNull()),
        inside(dx / pw), inside(dy / ph), inside(distance / G.hypot(pw, ph)), F.when(F.col("pt").isNotNull(), G.ordering_area(P) / page_area).otherwise(F.lit(0.0)),
        flag(F.col("__n")), flag(F.col("__ns")),
        (F.col("__r") - 1) / F.greatest(F.lit(1), F.col("__n") - 1),
        F.when(F.col("__same"), (F.col("__rs") - 1) / F.greatest(F.lit(1), F.col("__ns") - 1)).otherwise(one),
        flag(F.col("__r") == 1), flag(F.col("__same") & (F.col("__rs") == 1)),
        flag(dx < 0), flag(dx > 0), flag(dy < 0), flag(dy > 0),
        flag(G.contains_point(T, B.cx, B.cy)), flag(G.contains_point(B, T.cx, T.cy)),
    ]
    return ranked, [f.cast("double") for f in features]


def features_45(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, query, candidate and the 45 features of a text and a body as an array."""
    pairs, features = _features(spark, folder)
    return pairs.select("page_id", F.col("t_region_id").alias("query"), F.col("b_region_id").alias("candidate"), F.array(*features).alias("features"))


#: The 45 features in SQL, in their order.
_FEATURES = (
    "(t_x1 + t_x2) / 2.0 / 1600",
    "(t_y1 + t_y2) / 2.0 / 2200",
    "t_w / 1600",
    "t_h / 2200",
    "area_t / 3520000.0",
    "(b_x1 + b_x2) / 2.0 / 1600",
    "(b_y1 + b_y2) / 2.0 / 2200",
    "b_w / 1600",
    "b_h / 2200",
    "area_b / 3520000.0",
    "dx2 / 2.0 / 1600",
    "dy2 / 2.0 / 2200",
    "abs(dx2 / 2.0 / 1600)",
    "abs(dy2 / 2.0 / 2200)",
    "sqrt(d) / 2 / sqrt(1600.0 * 1600 + 2200.0 * 2200)",
    "gx / 1600",
    "gy / 2200",
    "sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) / sqrt(1600.0 * 1600 + 2200.0 * 2200)",
    "iw * ih / greatest(area_t + area_b - iw * ih, 1)",
    "iw * ih / greatest(area_t, 1)",
    "iw * ih / greatest(area_b, 1)",
    "iw / greatest(t_w, 1)",
    "iw / greatest(b_w, 1)",
    "ih / greatest(t_h, 1)",
    "ih / greatest(b_h, 1)",
    "ln(area_b / area_t)",
    "CASE WHEN same THEN 1.0 ELSE 0.0 END",
    "CASE WHEN pt IS NOT NULL THEN 1.0 ELSE 0.0 END",
    "CASE WHEN pb IS NOT NULL THEN 1.0 ELSE 0.0 END",
    "CASE WHEN same THEN dx2 / 2.0 / greatest(fw, 1) ELSE 0 END",
    "CASE WHEN same THEN dy2 / 2.0 / greatest(fh, 1) ELSE 0 END",
    "CASE WHEN same THEN sqrt(d) / 2 / sqrt(CAST(fw * fw + fh * fh AS DOUBLE)) ELSE 0 END",
    "coalesce(fw * fh / 3520000.0, 0)",
    "n",
    "ns",
    "(r - 1) / greatest(1, n - 1)",
    "CASE WHEN same THEN (rs - 1) / greatest(1, ns - 1) ELSE 1 END",
    "CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN same AND rs = 1 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN dx2 < 0 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN dx2 > 0 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN dy2 < 0 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN dy2 > 0 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN (b_x1 + b_x2) BETWEEN 2 * t_x1 AND 2 * t_x2 AND (b_y1 + b_y2) BETWEEN 2 * t_y1 AND 2 * t_y2 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN (t_x1 + t_x2) BETWEEN 2 * b_x1 AND 2 * b_x2 AND (t_y1 + t_y2) BETWEEN 2 * b_y1 AND 2 * b_y2 THEN 1.0 ELSE 0.0 END",
)
_AT, _AB = "(greatest(1, t_w) * greatest(1, t_h))", "(greatest(1, b_w) * greatest(1, b_h))"
_D = "(((t_x1 + t_x2) - (b_x1 + b_x2)) * ((t_x1 + t_x2) - (b_x1 + b_x2)) + ((t_y1 + t_y2) - (b_y1 + b_y2)) * ((t_y1 + t_y2) - (b_y1 + b_y2)))"


#: Rows k of pairs with all that the features are computed from.
PAIRS_45_SQL = f"""{_pair_sql()}, {PANEL_SQL},
j AS (
  SELECT p.*, pt.panel AS pt, pb.panel AS pb, coalesce(pt.panel = pb.panel, false) AS same, {_D} AS d, f.w AS fw, f.h AS fh
  FROM pair p JOIN panel pt ON pt.region_id = t_region_id JOIN panel pb ON pb.region_id = b_region_id LEFT JOIN region f ON f.region_id = pt.panel
),
k AS (
  SELECT *, count(*) OVER g AS n, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) OVER g AS BIGINT) AS ns, row_number() OVER (PARTITION BY page_id, t_region_id ORDER BY d, b_region_id) AS r,
    row_number() OVER (PARTITION BY page_id, t_region_id, same ORDER BY d, b_region_id) AS rs, {IW} AS iw, {IH} AS ih, {_AT} AS area_t, {_AB} AS area_b,
    (b_x1 + b_x2) - (t_x1 + t_x2) AS dx2, (b_y1 + b_y2) - (t_y1 + t_y2) AS dy2, greatest(0, t_x1 - b_x2, b_x1 - t_x2) AS gx, greatest(0, t_y1 - b_y2, b_y1 - t_y2) AS gy
  FROM j WINDOW g AS (PARTITION BY page_id, t_region_id)
)"""


@query(
    f"""WITH {PAIRS_45_SQL}
SELECT page_id, t_region_id AS query, b_region_id AS candidate, {", ".join(f"CAST(round({x}, 9) AS DOUBLE) AS f{i}" for i, x in enumerate(_FEATURES))}
FROM k""",
    digits=9,
)
def pair_features_45(spark: SparkSession, folder: str) -> DataFrame:
    """The 45 text-body features in their order."""
    pairs, features = _features(spark, folder)
    return pairs.select("page_id", F.col("t_region_id").alias("query"), F.col("b_region_id").alias("candidate"), *(f.alias(f"f{i}") for i, f in enumerate(features)))


@query(
    f"""WITH {_pair_sql()}
SELECT page_id, t_region_id AS text_id, CASE WHEN b.iou >= 0.1 THEN b.id END AS body_id, round(b.iou, 6) AS score FROM (
  SELECT page_id, t_region_id, max({{'iou': iou, 'o': -b_region_id, 'id': b_region_id}}) AS b FROM (
    SELECT r.page_id, r.region_id AS t_region_id, p.b_region_id, coalesce({IW} * {IH} / greatest(t_w * t_h + b_w * b_h - {IW} * {IH}, 1), 0.0) AS iou
    FROM region r LEFT JOIN pair p ON p.t_region_id = r.region_id WHERE r.cls = 'text') GROUP BY ALL)"""
)
def best_iou_match(spark: SparkSession, folder: str) -> DataFrame:
    """the best body of each text, accepted from an IoU of 0.1."""
    frame = X.regions(spark, folder)
    texts, bodies = X.of_class(frame, "text", "t"), X.of_class(frame, "body", "b")
    found = matching.best_match(texts, bodies, "page_id", "t_region_id", "b_region_id", G.iou(T, B), "b_region_id", 0.1)
    return found.withColumnsRenamed({"t_region_id": "text_id", "b_region_id": "body_id"})


@query(
    f"""WITH {R}, lines AS (SELECT r.page_id, r.region_id, x1, y1, x2, y2, w, h, p_name FROM region r JOIN part ON p_partkey = part_key WHERE cls = 'text'),
hit AS (
  SELECT b.page_id, b.region_id AS body_id, l.p_name, l.x1 + l.x2 AS sx, l.y1 + l.y2 AS sy FROM region b JOIN lines l ON b.page_id = l.page_id AND b.cls = 'body'
  WHERE ((l.x1 + l.x2) BETWEEN 2 * b.x1 AND 2 * b.x2 AND (l.y1 + l.y2) BETWEEN 2 * b.y1 AND 2 * b.y2)
    OR greatest(0, least(l.x2, b.x2) - greatest(l.x1, b.x1)) * greatest(0, least(l.y2, b.y2) - greatest(l.y1, b.y1)) / greatest(l.w * l.h, 1) >= 0.35)
SELECT b.page_id, b.region_id AS body_id, coalesce(string_agg(h.p_name, '' ORDER BY -sx, sy, p_name), '') AS text
FROM region b LEFT JOIN hit h ON h.body_id = b.region_id WHERE b.cls = 'body' GROUP BY ALL"""
)
def ocr_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines in each body box, right to left."""
    frame = X.regions(spark, folder)
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("t_part_key"), "p_name")
    lines = X.of_class(frame, "text", "t").join(names, "t_part_key")
    return matching.concat_lines(X.of_class(frame, "body", "b"), lines, "page_id", "b_region_id", B, T, "p_name").withColumnRenamed("b_region_id", "body_id")


def _overlap_edges(spark: SparkSession, folder: str, least: float = 0.35) -> DataFrame:
    return _pairs(spark, folder).filter(G.overlaps(T, B) & (G.iom(T, B) >= F.lit(least)))


@query(
    f"""WITH RECURSIVE {_pair_sql()},
cand AS (
  SELECT page_id, t_region_id, b_region_id, row_number() OVER (PARTITION BY page_id ORDER BY {IW} * {IH} DESC, t_region_id DESC, b_region_id DESC) AS k
  FROM pair WHERE {MEET} AND {IW} * {IH} / least(t_w * t_h, b_w * b_h) >= 0.35
),
walk AS (
  SELECT page_id, 0 AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS bs FROM (SELECT DISTINCT page_id FROM cand)
  UNION ALL
  SELECT w.page_id, w.k + 1, CASE WHEN list_contains(w.ts, c.t_region_id) OR list_contains(w.bs, c.b_region_id) THEN w.ts ELSE list_append(w.ts, c.t_region_id) END,
    CASE WHEN list_contains(w.ts, c.t_region_id) OR list_contains(w.bs, c.b_region_id) THEN w.bs ELSE list_append(w.bs, c.b_region_id) END
  FROM walk w JOIN cand c ON c.page_id = w.page_id AND c.k = w.k + 1
)
SELECT page_id, unnest(ts) AS text_id, unnest(bs) AS body_id FROM (SELECT page_id, ts, bs, row_number() OVER (PARTITION BY page_id ORDER BY k DESC) AS last FROM walk) WHERE last = 1"""
)
def greedy_match(spark: SparkSession, folder: str) -> DataFrame:
    """one-to-one text and body pairs, greatest overlap first, ties by the larger ids."""
    pairs = _overlap_edges(spark, folder).withColumn("inter", G.intersection(T, B))
    order = [-F.col("inter"), -F.col("t_region_id"), -F.col("b_region_id")]
    found = matching.greedy_match(pairs, ["page_id"], "t_region_id", "b_region_id", order)
    return found.withColumnsRenamed({"t_region_id": "text_id", "b_region_id": "body_id"})


@query(
    f"""WITH {_pair_sql()}, used AS (SELECT DISTINCT t_region_id FROM pair WHERE {MEET} AND {IW} * {IH} / least(t_w * t_h, b_w * b_h) >= 0.35)
SELECT page_id, count(*) AS left_over FROM region WHERE cls = 'text' AND region_id NOT IN (SELECT t_region_id FROM used) GROUP BY page_id"""
)
def leftover_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that overlap no body enough, per page."""
    texts = X.of_class(X.regions(spark, folder), "text", "t")
    return matching.leftovers(texts, _overlap_edges(spark, folder), ["page_id", "t_region_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("left_over"))


@query(
    f"""WITH RECURSIVE {_pair_sql()}, e AS (SELECT page_id, t_region_id AS a, b_region_id AS b FROM pair WHERE {MEET} AND {IW} * {IH} / least(t_w * t_h, b_w * b_h) >= 0.35),
s AS (SELECT page_id, a, b FROM e UNION ALL SELECT page_id, b, a FROM e),
reach AS (SELECT DISTINCT page_id, a AS node, a AS root FROM s UNION SELECT s.page_id, s.b, r.root FROM reach r JOIN s ON s.a = r.node),
lab AS (SELECT page_id, node, min(root) AS root FROM reach GROUP BY ALL)
SELECT l.page_id, root AS component, CAST(sum(CASE WHEN r.cls = 'text' THEN 1 ELSE 0 END) AS BIGINT) AS texts, CAST(sum(CASE WHEN r.cls = 'body' THEN 1 ELSE 0 END) AS BIGINT) AS bodies
FROM lab l JOIN region r ON r.region_id = l.node GROUP BY l.page_id, root"""
)
def overlap_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the overlap graph of each page, named by their least member."""
    found = graph.page_components(_overlap_edges(spark, folder), "page_id", "t_region_id", "b_region_id")
    n = lambda side: F.count_if(F.col("side") == side)
    sized = found.groupBy("page_id", "component").agg(F.min("member").alias("least"), n("a").alias("texts"), n("b").alias("bodies"))
    return sized.select("page_id", F.col("least").alias("component"), "texts", "bodies")


def greedy_sql(cand: str, name: str) -> str:
    """CTEs for the one-to-one match over ``cand(page_id, t_region_id, b_region_id, k)``, k = 1, 2, ... in each page."""
    free = "list_contains(w.ts, c.t_region_id) OR list_contains(w.bs, c.b_region_id)"
    return f"""{name}_walk AS (
  SELECT page_id, 0 AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS bs FROM (SELECT DISTINCT page_id FROM {cand})
  UNION ALL
  SELECT w.page_id, w.k + 1, CASE WHEN {free} THEN w.ts ELSE list_append(w.ts, c.t_region_id) END, CASE WHEN {free} THEN w.bs ELSE list_append(w.bs, c.b_region_id) END
  FROM {name}_walk w JOIN {cand} c ON c.page_id = w.page_id AND c.k = w.k + 1
),
{name} AS (SELECT page_id, unnest(ts) AS t_id, unnest(bs) AS b_id FROM (SELECT page_id, ts, bs, row_number() OVER (PARTITION BY page_id ORDER BY k DESC) AS last FROM {name}_walk) WHERE last = 1)"""


DIAGONAL = (X.PAGE_WIDTH**2 + X.PAGE_HEIGHT**2) ** 0.5
_GAP2 = "(power(greatest(0, t.x1 - b.x2, b.x1 - t.x2), 2) + power(greatest(0, t.y1 - b.y2, b.y1 - t.y2), 2))"
#: Candidates and matches of texts and tails (faces) of one panel.
TAIL_SQL = f"""{PANEL_SQL},
tail_cand AS (
  SELECT t.page_id, t.region_id AS t_region_id, b.region_id AS b_region_id, row_number() OVER (PARTITION BY t.page_id ORDER BY {_GAP2}, t.region_id, b.region_id) AS k
  FROM region t JOIN region b ON t.page_id = b.page_id AND t.cls = 'text' AND b.cls = 'face' JOIN panel pt ON pt.region_id = t.region_id JOIN panel pb ON pb.region_id = b.region_id AND pb.panel = pt.panel
  WHERE sqrt(CAST({_GAP2} AS DOUBLE)) / {DIAGONAL!r} <= 0.12
),
{greedy_sql("tail_cand", "tail")}"""
_CENTRE_IN = "(t.x1 + t.x2) BETWEEN 2 * b.x1 AND 2 * b.x2 AND (t.y1 + t.y2) BETWEEN 2 * b.y1 AND 2 * b.y2"
#: Candidates and matches of faces and bodies of one character.
FACE_SQL = f"""centre AS (
  SELECT t.page_id, t.region_id, min(f.rk)[2] AS panel FROM region t LEFT JOIN (SELECT page_id, x1, y1, x2, y2, [w * h, region_id] AS rk FROM region WHERE cls = 'frame') f
  ON t.page_id = f.page_id AND (t.x1 + t.x2) BETWEEN 2 * f.x1 AND 2 * f.x2 AND (t.y1 + t.y2) BETWEEN 2 * f.y1 AND 2 * f.y2 WHERE t.cls <> 'frame' GROUP BY t.page_id, t.region_id
),
face_pair AS (
  SELECT t.page_id, t.region_id AS t_region_id, b.region_id AS b_region_id, {_CENTRE_IN} AS inside, coalesce(pt.panel = pb.panel, false) AS same,
    round(sqrt(CAST(power((t.x1 + t.x2) - (b.x1 + b.x2), 2) + power((t.y1 + t.y2) - (b.y1 + b.y2), 2) AS DOUBLE)) / 2 / greatest(sqrt(CAST(power(b.x2 - b.x1, 2) + power(b.y2 - b.y1, 2) AS DOUBLE)), 1), 12) AS distance
  FROM region t JOIN region b ON t.page_id = b.page_id AND t.cls = 'face' AND b.cls = 'body' AND t.supp_key % 7 = b.supp_key % 7 JOIN centre pt ON pt.region_id = t.region_id JOIN centre pb ON pb.region_id = b.region_id
),
face_cand AS (
  SELECT page_id, t_region_id, b_region_id, row_number() OVER (PARTITION BY page_id ORDER BY NOT inside, NOT same, distance, t_region_id, b_region_id) AS k
  FROM face_pair WHERE inside OR (same AND distance <= 0.75)
),
{greedy_sql("face_cand", "face_body")}"""


def ray_interval_sql(o: tuple[str, str], d: tuple[str, str], box: tuple[str, str, str, str]) -> tuple[str, str, str]:
    """Enter, leave and whether a ray meets a box (x1, y1, x2, y2)."""
    flat = [f"abs({x}) < 1e-9" for x in d]
    sides = [((f"({box[i]} - {o[i]}) / {d[i]}"), f"({box[i + 2]} - {o[i]}) / {d[i]}") for i in (0, 1)]
    enter = "greatest(0.0, " + ", ".join(f"CASE WHEN {f} THEN 0.0 ELSE least({a}, {b}) END" for f, (a, b) in zip(flat, sides, strict=True)) + ")"
    leave = "least(" + ", ".join(f"CASE WHEN {f} THEN 1e300 ELSE greatest({a}, {b}) END" for f, (a, b) in zip(flat, sides, strict=True)) + ")"
    beside = " AND ".join(f"(NOT ({f}) OR {o[i]} BETWEEN {box[i]} AND {box[i + 2]})" for i, f in enumerate(flat))
    return enter, leave, f"({beside} AND {leave} >= {enter})"


def ray_exit_sql(o: tuple[str, str], d: tuple[str, str], box: tuple[str, str, str, str]) -> str:
    sides = [f"CASE WHEN {d[i]} > 1e-9 THEN ({box[i + 2]} - {o[i]}) / {d[i]} WHEN {d[i]} < -1e-9 THEN ({box[i]} - {o[i]}) / {d[i]} END" for i in (0, 1)]
    return "coalesce(least(" + ", ".join(f"CASE WHEN {x} >= 0 THEN {x} END" for x in sides) + "), 0.0)"


def diagonals_sql(source: str) -> str:
    """Two rows per row of ``source`` (text t_*, tail b_*): diagonal, cosine, root and tip."""
    near = "sqrt(power(one_x - t_cx, 2) + power(one_y - t_cy, 2)) <= sqrt(power(two_x - t_cx, 2) + power(two_y - t_cy, 2))"
    return f"""(SELECT *, ((tip_x - root_x) * (b_cx - t_cx) + (tip_y - root_y) * (b_cy - t_cy))
    / greatest(sqrt(power(tip_x - root_x, 2) + power(tip_y - root_y, 2)) * sqrt(power(b_cx - t_cx, 2) + power(b_cy - t_cy, 2)), 1e-9) AS cosine FROM (
  SELECT *, CASE WHEN {near} THEN one_x ELSE two_x END AS root_x, CASE WHEN {near} THEN one_y ELSE two_y END AS root_y, CASE WHEN {near} THEN two_x ELSE one_x END AS tip_x, CASE WHEN {near} THEN two_y ELSE one_y END AS tip_y FROM (
    SELECT *, n AS diagonal, b_x1::DOUBLE AS one_x, b_x2::DOUBLE AS two_x, CASE n WHEN 0 THEN b_y1 ELSE b_y2 END::DOUBLE AS one_y, CASE n WHEN 0 THEN b_y2 ELSE b_y1 END::DOUBLE AS two_y FROM {source}, range(2) d(n))))"""


#: Assigned tails with the boxes of text (t_), tail (b_) and the text's panel (p_).
TAIL_BOX_SQL = """tail_box AS (
  SELECT a.page_id, a.t_id, a.b_id, p.panel, f.x1 AS p_x1, f.y1 AS p_y1, f.x2 AS p_x2, f.y2 AS p_y2, b.x1 AS b_x1, b.y1 AS b_y1, b.x2 AS b_x2, b.y2 AS b_y2,
    (t.x1 + t.x2) / 2.0 AS t_cx, (t.y1 + t.y2) / 2.0 AS t_cy, (b.x1 + b.x2) / 2.0 AS b_cx, (b.y1 + b.y2) / 2.0 AS b_cy
  FROM tail a JOIN region t ON t.region_id = a.t_id JOIN region b ON b.region_id = a.b_id JOIN panel p ON p.region_id = a.t_id JOIN region f ON f.region_id = p.panel
)"""
#: Bodies with their panel and the box of their face (e_), null without one.
CAST_SQL = """person AS (
  SELECT c.page_id, c.region_id AS body_id, p.panel AS c_panel, c.x1 AS c_x1, c.y1 AS c_y1, c.x2 AS c_x2, c.y2 AS c_y2, e.x1 AS e_x1, e.y1 AS e_y1, e.x2 AS e_x2, e.y2 AS e_y2
  FROM region c JOIN panel p ON p.region_id = c.region_id LEFT JOIN face_body m ON m.b_id = c.region_id LEFT JOIN region e ON e.region_id = m.t_id WHERE c.cls = 'body'
)"""


def _same_panel_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and faces (as tails) of one panel with their gap."""
    frame = X.regions(spark, folder)
    panel = panels_of(frame).filter("panel IS NOT NULL")
    texts = X.of_class(frame, "text", "t").join(panel.withColumnRenamed("region_id", "t_region_id"), ["page_id", "t_region_id"])
    tails = X.of_class(frame, "face", "b").join(panel.withColumnRenamed("region_id", "b_region_id"), ["page_id", "b_region_id"])
    return texts.join(tails, ["page_id", "panel"])


@query(f"WITH RECURSIVE {R}, {TAIL_SQL} SELECT page_id, t_id AS text_id, b_id AS tail_id FROM tail")
def tail_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """one-to-one text and tail pairs of one panel within 0.12 page diagonals, nearest first."""
    diagonal = (X.PAGE_WIDTH**2 + X.PAGE_HEIGHT**2) ** 0.5
    pairs = _same_panel_tails(spark, folder).withColumn("gap", G.gap_distance(T, B) / diagonal).filter("gap <= 0.12")
    found = matching.greedy_match(pairs, ["page_id"], "t_region_id", "b_region_id", [F.col("gap"), F.col("t_region_id"), F.col("b_region_id")])
    return found.withColumnsRenamed({"t_region_id": "text_id", "b_region_id": "tail_id"})


def people(spark: SparkSession, folder: str) -> DataFrame:
    """bodies as c_* with their panel, and the box of the face matched to them as e_*, null without one."""
    frame = X.regions(spark, folder)
    panel = panels_of(frame).withColumnsRenamed({"region_id": "c_region_id", "panel": "c_panel"})
    faces = X.of_class(frame, "face", "e").select("page_id", F.col("e_region_id").alias("face_id"), "e_x1", "e_y1", "e_x2", "e_y2")
    matched = face_body_match(spark, folder).filter("face_id IS NOT NULL").select("page_id", F.col("body_id").alias("c_region_id"), "face_id")
    bodies = X.of_class(frame, "body", "c").join(panel, ["page_id", "c_region_id"])
    return bodies.join(matched.join(faces, ["page_id", "face_id"]), ["page_id", "c_region_id"], "left")


def tail_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Assigned tails (b_*) with their text (t_*) and the text's panel (p_*)."""
    frame = X.regions(spark, folder)
    tails = tail_assignment(spark, folder).withColumnsRenamed({"text_id": "t_region_id", "tail_id": "b_region_id"})
    joined = tails.join(X.of_class(frame, "text", "t"), ["page_id", "t_region_id"]).join(X.of_class(frame, "face", "b"), ["page_id", "b_region_id"])
    panel = panels_of(frame).withColumnRenamed("region_id", "t_region_id")
    return joined.join(panel, ["page_id", "t_region_id"]).join(frames_of(frame, "panel"), ["page_id", "panel"])


CORRIDOR = max(0.03 * DIAGONAL, 1.0)
_RAY = ("tip_x", "tip_y"), ("dx", "dy")
_TARGET = tuple(f"coalesce(e_{c}, c_{c})" for c in ("x1", "y1", "x2", "y2"))


def _tail_rays_sql() -> str:
    x1, y1, x2, y2 = _TARGET
    enter, _, meets = ray_interval_sql(*_RAY, ("g_x1", "g_y1", "g_x2", "g_y2"))
    reach = ", ".join(f"CASE WHEN abs({u}) > 1e-9 THEN greatest((b_{c}2 - b_{c}1) / 2.0, 0.5) / abs({u}) ELSE 1e300 END" for u, c in (("ux", "x"), ("uy", "y")))
    return f"""WITH RECURSIVE {R}, {TAIL_SQL}, {FACE_SQL}, {TAIL_BOX_SQL}, {CAST_SQL},
way AS (SELECT *, (b_cx - t_cx) / greatest(sqrt(power(b_cx - t_cx, 2) + power(b_cy - t_cy, 2)), 1e-6) AS ux, (b_cy - t_cy) / greatest(sqrt(power(b_cx - t_cx, 2) + power(b_cy - t_cy, 2)), 1e-6) AS uy FROM tail_box),
seg AS (SELECT *, b_cx - ux * least({reach}) AS root_x, b_cy - uy * least({reach}) AS root_y, b_cx + ux * least({reach}) AS tip_x, b_cy + uy * least({reach}) AS tip_y FROM way),
ray AS (SELECT *, (tip_x - root_x) / greatest(sqrt(power(tip_x - root_x, 2) + power(tip_y - root_y, 2)), 1e-6) AS dx, (tip_y - root_y) / greatest(sqrt(power(tip_x - root_x, 2) + power(tip_y - root_y, 2)), 1e-6) AS dy FROM seg),
best AS (SELECT t_id AS best_id, diagonal FROM (SELECT t_id, diagonal, row_number() OVER (PARTITION BY t_id ORDER BY -cosine, diagonal) AS r FROM {diagonals_sql("tail_box")}) WHERE r = 1),
aim AS (SELECT r.*, q.*, best.diagonal, {x1} AS g_x1, {y1} AS g_y1, {x2} AS g_x2, {y2} AS g_y2, {ray_exit_sql(*_RAY, ("p_x1", "p_y1", "p_x2", "p_y2"))} AS ex FROM ray r JOIN person q ON q.page_id = r.page_id JOIN best ON best.best_id = r.t_id),
v AS (SELECT *, {enter} AS enter, {meets} AS meets, ((g_x1 + g_x2) / 2.0 - tip_x) * dx + ((g_y1 + g_y2) / 2.0 - tip_y) * dy AS along, abs(((g_x1 + g_x2) / 2.0 - tip_x) * dy - ((g_y1 + g_y2) / 2.0 - tip_y) * dx) AS off,
  0.5 * sqrt(power(g_x2 - g_x1, 2) + power(g_y2 - g_y1, 2)) AS half FROM aim)
SELECT page_id, t_id AS text_id, b_id AS tail_id, diagonal, body_id, round(CASE WHEN NOT coalesce(c_panel = panel, false) THEN 0.0 WHEN meets AND enter <= ex THEN 1.0
  WHEN along > 0 AND along <= ex THEN exp(-greatest(0.0, off - half) / {CORRIDOR!r}) ELSE 0.0 END, 6) AS prior FROM v"""


@query(_tail_rays_sql())
def tail_rays(spark: SparkSession, folder: str) -> DataFrame:
    """The ray of each assigned tail and the prior of every body of its panel.

    The target is a body's face where it has one, else the body.
    """
    joined = tail_boxes(spark, folder).withColumn("seg", G.tail_segment(B, T)).withColumn("diagonal", F.get(G.diagonal_segments(B, T), F.lit(0))["diagonal"])
    norm = F.greatest(G.hypot(F.col("seg.tip_x") - F.col("seg.root_x"), F.col("seg.tip_y") - F.col("seg.root_y")), F.lit(1e-6))
    rays = joined.withColumns({"dx": (F.col("seg.tip_x") - F.col("seg.root_x")) / norm, "dy": (F.col("seg.tip_y") - F.col("seg.root_y")) / norm})
    ox, oy, dx, dy = F.col("seg.tip_x"), F.col("seg.tip_y"), F.col("dx"), F.col("dy")
    rays = rays.withColumn("exit", G.ray_exit(ox, oy, dx, dy, Box.of("p_")))
    pairs = rays.join(people(spark, folder), "page_id")
    C = Box(*(F.coalesce(f"e_{c}", f"c_{c}") for c in ("x1", "y1", "x2", "y2")))
    vx, vy = C.cx - ox, C.cy - oy
    projection, off = vx * dx + vy * dy, F.abs(vx * dy - vy * dx)
    edge = F.greatest(F.lit(0.0), off - 0.5 * G.hypot(C.width, C.height))
    hit = G.ray_hit(ox, oy, dx, dy, C)
    prior = (
        F.when(~F.coalesce(F.col("c_panel") == F.col("panel"), F.lit(False)), 0.0)
        .when(hit.isNotNull() & (hit <= F.col("exit")), 1.0)
        .when((projection > 0) & (projection <= F.col("exit")), F.exp(-edge / CORRIDOR))
        .otherwise(0.0)
    )
    return pairs.select("page_id", F.col("t_region_id").alias("text_id"), F.col("b_region_id").alias("tail_id"), "diagonal", F.col("c_region_id").alias("body_id"), prior.alias("prior"))


@query(
    f"""WITH RECURSIVE ray_prior AS ({_tail_rays_sql()}), {E},
f AS (SELECT e.page_id, e.query AS text_id, e.candidate AS body_id, e.score / 1e6 AS score, p.prior FROM edge e LEFT JOIN ray_prior p ON p.text_id = e.query AND p.body_id = e.candidate),
r AS (SELECT *, round(score + 6.0 * coalesce(prior, 0.0), 6) AS fused, CASE WHEN prior IS NULL THEN 'fallback' ELSE 'tail_fusion' END AS source FROM f)
SELECT page_id, text_id, body_id, rank, round(score, 6) AS score, fused, source FROM (SELECT *, row_number() OVER (PARTITION BY page_id, text_id ORDER BY fused DESC, body_id) AS rank FROM r) WHERE rank <= 3""",
    rounded=("fused",),
)
def tail_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Scores plus six times the prior, the three best candidates of each text."""
    from inkframe.operators.vectors import fuse

    scored = X.edges(spark, folder).select("page_id", F.col("query").alias("text_id"), F.col("candidate").alias("body_id"), (F.col("score") / 1e6).alias("score"))
    fused = fuse(scored, tail_rays(spark, folder), ["page_id", "text_id", "body_id"])
    # A score and a prior that cancel may leave a sum just below zero: -0.0 in SQL. F.round drops that sign, rint keeps it.
    fused = fused.withColumn("fused", F.rint(F.col("fused") * 1e6) / 1e6)
    best = ranking.top_k(fused, ["page_id", "text_id"], "fused", "body_id", 3)
    return best.select("page_id", "text_id", "body_id", "rank", "score", "fused", "source")


#: I4: panels folded into bands; a state is a list of bands and the band of each panel so far.
_SHARED = "list_transform(w.bands, lambda b: greatest(0, least(f.y2, b.hi) - greatest(f.y1, b.lo)) / greatest(1, least(greatest(1, f.y2 - f.y1), b.hi - b.lo)))"
_BAND_SQL = f"""fr AS (SELECT page_id, region_id, y1::DOUBLE AS y1, y2::DOUBLE AS y2, x2, row_number() OVER (PARTITION BY page_id ORDER BY y1, -x2, region_id) AS k FROM region WHERE cls = 'frame'),
fold AS (
  SELECT DISTINCT page_id, 0 AS k, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE)[]) AS bands, CAST([] AS BIGINT[]) AS places FROM fr
  UNION ALL
  SELECT page_id, k, CASE WHEN fits THEN list_transform(bands, lambda b, j: CASE WHEN j = i THEN {{'lo': least(b.lo, y1), 'hi': greatest(b.hi, y2)}} ELSE b END) ELSE list_append(bands, {{'lo': y1, 'hi': y2}}) END,
    list_append(places, CASE WHEN fits THEN i ELSE len(bands) + 1 END) FROM (
    SELECT *, coalesce(list_max(shares) >= 0.35, false) AS fits, list_position(shares, list_max(shares)) AS i FROM (
      SELECT w.page_id, w.k + 1 AS k, w.bands, w.places, f.y1, f.y2, {_SHARED} AS shares FROM fold w JOIN fr f ON f.page_id = w.page_id AND f.k = w.k + 1))),
done AS (SELECT page_id, bands, places FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k DESC) AS r FROM fold) WHERE r = 1),
ranked AS (SELECT fr.page_id, fr.region_id AS panel, row_number() OVER (PARTITION BY fr.page_id ORDER BY d.bands[d.places[fr.k]].lo, d.places[fr.k], -fr.x2, fr.k) - 1 AS panel_rank FROM fr JOIN done d ON d.page_id = fr.page_id),
n AS (SELECT page_id, count(*) AS frames FROM fr GROUP BY page_id)"""


@query(
    f"""WITH RECURSIVE {R}, {PANEL_SQL}, {_BAND_SQL}
SELECT t.page_id, t.region_id, p.panel, row_number() OVER (PARTITION BY t.page_id ORDER BY CASE WHEN coalesce(n.frames, 0) = 0 THEN 0 WHEN p.panel IS NULL THEN n.frames + (t.y1 + t.y2) / 2.0 ELSE coalesce(k.panel_rank, n.frames) END,
  -(t.x1 + t.x2), t.y1 + t.y2, t.region_id) AS reading
FROM region t JOIN panel p ON p.region_id = t.region_id LEFT JOIN ranked k ON k.panel = p.panel AND k.page_id = t.page_id LEFT JOIN n ON n.page_id = t.page_id WHERE t.cls = 'text'"""
)
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each page in reading order over bands of panels."""
    frame = X.regions(spark, folder)
    panels = ranking.panel_order(frame.filter("cls = 'frame'"), "page_id", "region_id", "y1", "y2", "x2")
    texts = X.of_class(frame, "text", "t").withColumnRenamed("t_region_id", "region_id").join(panels_of(frame), ["page_id", "region_id"])
    return ranking.reading_order(texts, panels, "page_id", "region_id", T.cx, T.cy).select("page_id", "region_id", "panel", "reading")


@query(
    f"""WITH {R}, {PANEL_SQL}
SELECT t.page_id, t.region_id, p.panel, row_number() OVER (PARTITION BY t.page_id ORDER BY f.y1 NULLS LAST, f.x2 DESC NULLS LAST, -(t.x1 + t.x2), t.y1 + t.y2, t.region_id) AS reading
FROM region t JOIN panel p ON p.region_id = t.region_id LEFT JOIN region f ON f.region_id = p.panel WHERE t.cls = 'text'"""
)
def simple_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """The older order by panel top and right side."""
    frame = X.regions(spark, folder)
    panels = frame.filter("cls = 'frame'").select("page_id", F.col("region_id").alias("panel"), F.col("y1").alias("fy"), F.col("x2").alias("fx"))
    texts = X.of_class(frame, "text", "t").withColumnRenamed("t_region_id", "region_id").join(panels_of(frame), ["page_id", "region_id"])
    return ranking.simple_reading_order(texts, panels, "page_id", "region_id", "fy", "fx", T.cx, T.cy).select("page_id", "region_id", "panel", "reading")


@query(
    f"""WITH {R}
SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY y1 + y2, -(x1 + x2), region_id) AS body_number,
  printf('P%03d_C%03d', page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_id)) AS instance_id FROM region WHERE cls = 'body'"""
)
def body_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and ids of the bodies of a page."""
    from inkframe.functions.text import instance_id

    bodies = X.regions(spark, folder).filter("cls = 'body'")
    b = Box.of()
    numbered = ranking.body_labels(bodies, "page_id", b.y1 + b.y2, b.x1 + b.x2, "region_id")
    order = ranking.Window.partitionBy("page_id").orderBy("y1", "x1", "region_id")
    return numbered.select("page_id", "region_id", "body_number", instance_id(F.col("page_id"), F.row_number().over(order)).alias("instance_id"))


def _face_body_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """F11 candidates: faces and bodies of one character, the centre inside or in one panel and near."""
    frame = X.regions(spark, folder)
    panel = panels_of(frame, fallback=False)
    faces = X.of_class(frame, "face", "t").join(panel.withColumnsRenamed({"region_id": "t_region_id", "panel": "pt"}), ["page_id", "t_region_id"])
    bodies = X.of_class(frame, "body", "b").join(panel.withColumnsRenamed({"region_id": "b_region_id", "panel": "pb"}), ["page_id", "b_region_id"])
    same_id = F.col("t_supp_key") % 7 == F.col("b_supp_key") % 7
    pairs = faces.join(bodies, "page_id").filter(same_id)
    inside, same = G.contains_centre(B, T), F.coalesce(F.col("pt") == F.col("pb"), F.lit(False))
    rated = pairs.withColumns({"inside": inside, "same": same, "distance": F.round(G.relative_centre_distance(T, B), 12)})
    return rated.filter("inside OR (same AND distance <= 0.75)")


@query(
    f"""WITH RECURSIVE {R}, {FACE_SQL}
SELECT b.page_id, b.region_id AS body_id, m.t_id AS face_id, CASE WHEN m.t_id IS NULL THEN 'body-only' ELSE 'face+body' END AS input_type FROM region b LEFT JOIN face_body m ON m.b_id = b.region_id WHERE b.cls = 'body'"""
)
def face_body_match(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one faces and bodies of one character; bodies alone are body-only, faces alone are dropped."""
    order = [~F.col("inside"), ~F.col("same"), F.col("distance"), F.col("t_region_id"), F.col("b_region_id")]
    pairs = matching.greedy_match(_face_body_pairs(spark, folder), ["page_id"], "t_region_id", "b_region_id", order)
    bodies = X.of_class(X.regions(spark, folder), "body", "b").select("page_id", "b_region_id")
    joined = bodies.join(pairs, ["page_id", "b_region_id"], "left")
    kind = F.when(F.col("t_region_id").isNotNull(), "face+body").otherwise("body-only")
    return joined.select("page_id", F.col("b_region_id").alias("body_id"), F.col("t_region_id").alias("face_id"), kind.alias("input_type"))


@query(
    f"""WITH {_pair_sql("text", "body")}, named AS (
  SELECT p.*, a.p_name AS ta, b.p_name AS tb FROM pair p JOIN part a ON a.p_partkey = t_part_key JOIN part b ON b.p_partkey = b_part_key)
SELECT page_id, count(*) AS overlaps, CAST(sum(CASE WHEN ta = tb THEN 1 ELSE 0 END) AS BIGINT) AS same_text, CAST(sum(CASE WHEN ta <> tb THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
FROM named WHERE {MEET} AND {IW} * {IH} / least(t_w * t_h, b_w * b_h) >= 0.35 GROUP BY page_id"""
)
def dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping regions of two sources with equal or different text, per page."""
    names = table(spark, folder, "part").select("p_partkey", "p_name")
    pairs = _overlap_edges(spark, folder)
    pairs = pairs.join(names.withColumnsRenamed({"p_partkey": "t_part_key", "p_name": "ta"}), "t_part_key")
    pairs = pairs.join(names.withColumnsRenamed({"p_partkey": "b_part_key", "p_name": "tb"}), "b_part_key")
    equal = F.col("ta") == F.col("tb")
    return pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("overlaps"), F.count_if(equal).alias("same_text"), F.count_if(~equal).alias("conflicts"))


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS rank FROM edge),
h AS (SELECT *, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS hits FROM r)
SELECT page_id, query, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS positives, CAST(sum(CASE WHEN label AND rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1,
  CAST(max(CASE WHEN label AND rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS top3, round(1 / min(CASE WHEN label THEN rank END), 6) AS reciprocal_rank,
  round(sum(CASE WHEN label AND rank = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN label THEN 1 ELSE 0 END), 6) AS recall1,
  round(sum(CASE WHEN label AND rank <= 3 THEN 1 ELSE 0 END) / sum(CASE WHEN label THEN 1 ELSE 0 END), 6) AS recall3,
  round(2 * sum(CASE WHEN label AND rank = 1 THEN 1 ELSE 0 END) / (1 + sum(CASE WHEN label THEN 1 ELSE 0 END)), 6) AS f1_at1,
  round(sum(CASE WHEN label THEN hits / rank END) / sum(CASE WHEN label THEN 1 ELSE 0 END), 6) AS average_precision,
  CAST(CASE WHEN sum(CASE WHEN label THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN label AND rank = 1 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS BIGINT) AS exact1
FROM h GROUP BY page_id, query HAVING sum(CASE WHEN label THEN 1 ELSE 0 END) > 0"""
)
def rank_metrics_listwise(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking metrics of every query that has a positive."""
    return metrics.listwise_metrics(X.edges(spark, folder), "page_id", "query", "candidate", "score", "label")


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS rank FROM edge),
q AS (SELECT page_id, query, sum(CASE WHEN label THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label AND rank = 1 THEN 1 ELSE 0 END) AS t1,
   max(CASE WHEN label AND rank <= 3 THEN 1 ELSE 0 END) AS t3, 1 / min(CASE WHEN label THEN rank END) AS rr FROM r GROUP BY ALL HAVING sum(CASE WHEN label THEN 1 ELSE 0 END) > 0)
SELECT count(*) AS queries, round(avg(t1), 6) AS top1, round(avg(t3), 6) AS top3, round(avg(rr), 6) AS reciprocal_rank,
  round(sum(t1) / count(*), 6) AS micro_precision, round(sum(t1) / sum(pos), 6) AS micro_recall,
  round(2 * (sum(t1) / count(*)) * (sum(t1) / sum(pos)) / ((sum(t1) / count(*)) + (sum(t1) / sum(pos))), 6) AS micro_f1 FROM q"""
)
def micro_macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over queries and micro scores."""
    found = metrics.listwise_summary(metrics.listwise_metrics(X.edges(spark, folder), "page_id", "query", "candidate", "score", "label"))
    return found.select("queries", "top1", "top3", "reciprocal_rank", "micro_precision", "micro_recall", "micro_f1")


@query(
    f"""WITH {E}, p AS (SELECT page_id, query FROM edge GROUP BY ALL HAVING bool_or(label))
SELECT e.page_id, e.query, round(ln(sum(exp((score - m) / 1e5))) - ln(sum(CASE WHEN label THEN exp((score - m) / 1e5) END)), 5) AS loss
FROM (SELECT *, max(score) OVER (PARTITION BY page_id, query) AS m FROM edge) e JOIN p ON p.page_id = e.page_id AND p.query = e.query
GROUP BY e.page_id, e.query HAVING min(CASE WHEN label THEN (m - score) / 1e5 END) < 600"""
)
def listwise_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The loss of queries with a positive within reach of double precision."""
    from inkframe.operators.checks import without_positive

    group = ["page_id", "query"]
    edges = X.edges(spark, folder)
    usable = edges.join(without_positive(edges, group, "label"), group, "left_anti")
    loss = metrics.listwise_loss(usable, group, F.col("score") / 1e5, "label").filter("loss < 600")
    return loss.withColumn("loss", F.round("loss", 5))


@query(
    f"""WITH {E}, a AS (SELECT page_id, query, candidate, label, row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS ra,
  row_number() OVER (PARTITION BY page_id, query ORDER BY score % 997 DESC, candidate) AS rb FROM edge),
o AS (SELECT page_id, query, bool_or(label AND ra = 1) AS a, bool_or(label AND rb = 1) AS b, max(CASE WHEN ra = 1 THEN candidate END) AS ca, max(CASE WHEN rb = 1 THEN candidate END) AS cb FROM a GROUP BY ALL)
SELECT count(*) FILTER (a AND b) AS both_correct, count(*) FILTER (NOT a AND b) AS corrected, count(*) FILTER (a AND NOT b) AS regressed, count(*) FILTER (NOT a AND NOT b) AS both_wrong,
  count(*) FILTER (ca = cb) AS agreement, count(*) FILTER (NOT a AND b) - count(*) FILTER (a AND NOT b) AS net_gain,
  round(count(*) FILTER (a) / greatest(count(*), 1), 6) AS first_accuracy, round(count(*) FILTER (b) / greatest(count(*), 1), 6) AS second_accuracy FROM o"""
)
def model_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of the same queries, their outcomes and net gain."""
    edges = X.edges(spark, folder).withColumn("other", F.col("score") % 997)
    group = ["page_id", "query"]
    first = ranking.top_k(edges, group, "score", "candidate", 1)
    second = ranking.top_k(edges, group, "other", "candidate", 1)
    return metrics.win_loss(metrics.compare_models(first, second, group, "label", "candidate"))


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS rank FROM edge),
q AS (SELECT page_id, query, min(CASE WHEN label THEN rank END) AS best_rank, max(score) AS top, max(CASE WHEN label THEN score END) AS right_score, bool_or(label AND rank = 1) AS ok FROM r GROUP BY ALL)
SELECT page_id, query, best_rank, CAST(top - right_score AS BIGINT) AS behind FROM q WHERE NOT ok AND best_rank IS NOT NULL"""
)
def error_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Queries whose first place is wrong, the rank of the best right candidate and how far it is behind."""
    group = ["page_id", "query"]
    order = ranking.Window.partitionBy(*group).orderBy(F.desc("score"), "candidate")
    ranked = X.edges(spark, folder).withColumn("rank", F.row_number().over(order))
    label = F.col("label")
    found = ranked.groupBy(*group).agg(
        F.min(F.when(label, F.col("rank"))).alias("best_rank"), (F.max("score") - F.max(F.when(label, F.col("score")))).alias("behind")
    )
    return found.filter("best_rank > 1")
