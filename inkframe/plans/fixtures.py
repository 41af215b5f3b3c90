"""Derived views that give every operator an input on the data tables.

Integer arithmetic throughout, so that results are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.session import table

PAGE_WIDTH, PAGE_HEIGHT = 1600, 2200


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, region_id, ord, cls, x1, y1, x2, y2, w, h and the part, supplier and order keys."""
    lines = table(spark, folder, "lineitem")
    part, supplier, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    number = F.col("l_linenumber").cast("long")
    kind = (part + number + order) % 8
    cls = F.when(kind < 3, "text").when(kind < 6, "body").when(kind == 6, "face").otherwise("frame")
    w = F.when(kind == 7, 300 + (13 * part) % 300).otherwise(20 + 4 * F.col("l_quantity").cast("long"))
    h = (
        F.when(kind == 7, 300 + (29 * supplier) % 400)
        .when(kind == 6, 15 + 2 * (part % 20))
        .otherwise(20 + 5 * (part % 50))
    )
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    # Orders of one page lie in one key range, so the window shuffles once by page.
    inside = Window.partitionBy("page_id").orderBy(*keys)
    boxes = lines.select(*keys, F.expr("l_orderkey div 10").alias("page_id"), cls.alias("cls"), w.alias("w"), h.alias("h"))
    placed = boxes.withColumn("ord", F.row_number().over(inside).cast("long"))
    x1 = (7919 * part + 104729 * number + 31 * order) % 1000
    y1 = (6151 * supplier + 37 * part + 17 * order) % 1400
    return placed.select(
        "page_id",
        (F.col("page_id") * 1000 + F.col("ord")).alias("region_id"),
        "ord",
        "cls",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + F.col("w")).alias("x2"),
        (y1 + F.col("h")).alias("y2"),
        "w",
        "h",
        part.alias("part_key"),
        supplier.alias("supp_key"),
        order.alias("order_key"),
    )


REGION_SQL = """
region AS (
  SELECT page_id, page_id * 1000 + ord AS region_id, ord, cls, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h, part_key, supp_key, order_key
  FROM (
    SELECT l_orderkey // 10 AS page_id,
      row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_shipdate) AS ord,
      CASE WHEN k < 3 THEN 'text' WHEN k < 6 THEN 'body' WHEN k = 6 THEN 'face' ELSE 'frame' END AS cls,
      CASE WHEN k = 7 THEN 300 + (13 * l_partkey) % 300 ELSE 20 + 4 * CAST(l_quantity AS BIGINT) END AS w,
      CASE WHEN k = 7 THEN 300 + (29 * l_suppkey) % 400 WHEN k = 6 THEN 15 + 2 * (l_partkey % 20) ELSE 20 + 5 * (l_partkey % 50) END AS h,
      (7919 * l_partkey + 104729 * CAST(l_linenumber AS BIGINT) + 31 * l_orderkey) % 1000 AS x1,
      (6151 * l_suppkey + 37 * l_partkey + 17 * l_orderkey) % 1400 AS y1,
      l_partkey AS part_key, l_suppkey AS supp_key, l_orderkey AS order_key
    FROM (SELECT *, (l_partkey + l_linenumber + l_orderkey) % 8 AS k FROM lineitem)
  )
)"""


def of_class(frame: DataFrame, cls: str, prefix: str) -> DataFrame:
    """Regions of one class with prefixed columns, page_id aside."""
    names = ("region_id", "ord", "x1", "y1", "x2", "y2", "w", "h", "part_key", "supp_key")
    return frame.filter(F.col("cls") == cls).select("page_id", *(F.col(n).alias(f"{prefix}_{n}") for n in names))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Text x body pairs of a page: integer score (minus the squared distance of doubled centres) and label."""
    frame = regions(spark, folder)
    texts, bodies = of_class(frame, "text", "t"), of_class(frame, "body", "b")
    dx = (F.col("t_x1") + F.col("t_x2")) - (F.col("b_x1") + F.col("b_x2"))
    dy = (F.col("t_y1") + F.col("t_y2")) - (F.col("b_y1") + F.col("b_y2"))
    return texts.join(bodies, "page_id").select(
        "page_id",
        F.col("t_region_id").alias("query"),
        F.col("b_region_id").alias("candidate"),
        (-(dx * dx + dy * dy)).alias("score"),
        ((F.col("t_part_key") + F.col("b_part_key")) % 5 == 0).alias("label"),
    )


EDGE_SQL = (
    REGION_SQL
    + """,
edge AS (
  SELECT t.page_id, t.region_id AS query, b.region_id AS candidate,
    -(((t.x1 + t.x2) - (b.x1 + b.x2)) * ((t.x1 + t.x2) - (b.x1 + b.x2)) + ((t.y1 + t.y2) - (b.y1 + b.y2)) * ((t.y1 + t.y2) - (b.y1 + b.y2))) AS score,
    (t.part_key + b.part_key) % 5 = 0 AS label
  FROM region t JOIN region b ON t.page_id = b.page_id AND t.cls = 'text' AND b.cls = 'body'
)"""
)


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, book, label, input_type and vec of the embedding table."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 5).alias("book"),
        "label",
        F.element_at(F.array(F.lit("face+body"), F.lit("body-only"), F.lit("face-only")), (F.col("vec_id") % 3 + 1).cast("int")).alias("input_type"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


INSTANCE_SQL = """
inst AS (
  SELECT vec_id, vec_id % 5 AS book, label, ['face+body', 'body-only', 'face-only'][(vec_id % 3 + 1)::INT] AS input_type,
    CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings
)"""


def predicted_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, book, truth and pred of a synthetic clustering."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 5).alias("book"),
        F.col("label").cast("long").alias("truth"),
        ((F.col("label") * 3 + F.col("vec_id") % 4) % 7).cast("long").alias("pred"),
    )


CLUSTER_SQL = """
clu AS (SELECT vec_id, vec_id % 5 AS book, CAST(label AS BIGINT) AS truth, CAST((label * 3 + vec_id % 4) % 7 AS BIGINT) AS pred FROM embeddings)"""


def label_texts(spark: SparkSession, folder: str) -> DataFrame:
    """id, split and text of the documents."""
    digit = F.col("doc_id") % 10
    split = F.when(digit <= 6, "train").when(digit <= 8, "val").otherwise("test")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), split.alias("split"), "text")


LABEL_TEXT_SQL = """
label_text AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <= 6 THEN 'train' WHEN doc_id % 10 <= 8 THEN 'val' ELSE 'test' END AS split, text FROM documents)"""
