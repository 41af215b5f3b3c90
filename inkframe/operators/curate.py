"""Reconciliation of two annotation sources: components, categories and the merged annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import text as T

NEAR = 0.85
MERGED = ("exact_duplicate", "near_duplicate", "group_duplicate", "near_group_duplicate")
AMBIGUOUS = ("partial_overlap", "complex_overlap", "many_to_many")


def category(empty_groups_match: bool = False) -> Column:
    """Category of a component with columns n_a, n_b, a_core, b_core (of the single members), similarity, joined, target.

    With ``empty_groups_match`` a group whose joined text is empty may be a
    group duplicate of an empty text, as in the first protocol.
    """
    c = F.col
    one = (c("n_a") == 1) & (c("n_b") == 1)
    group = ((c("n_a") == 1) & (c("n_b") > 1)) | ((c("n_a") > 1) & (c("n_b") == 1))
    filled = F.lit(True) if empty_groups_match else c("joined") != ""
    return (
        F.when(one & (c("a_core") != "") & (c("a_core") == c("b_core")), "exact_duplicate")
        .when(one & (c("similarity") >= NEAR), "near_duplicate")
        .when(one & T.either_contains(c("a_core"), c("b_core")), "partial_overlap")
        .when(one, "different_overlap")
        .when(group & filled & (c("joined") == c("target")), "group_duplicate")
        .when(group & (c("similarity") >= NEAR), "near_group_duplicate")
        .when(group & T.either_contains(c("joined"), c("target")), "partial_overlap")
        .when(group, "complex_overlap")
        .otherwise("many_to_many")
    )


def classify(members: DataFrame, page: str = "page_id") -> DataFrame:
    """Components with category, similarity and joined text, from rows (page, component, side a/b, member, text).

    Texts of a group are joined in the order of their members.
    """
    core = members.withColumn("core", T.core_text(F.col("text")))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("member", "core")))), lambda x: x["core"])
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("member"))))
    rows = core.groupBy(page, "component").agg(side("a").alias("a"), side("b").alias("b"), ids("a").alias("a_ids"), ids("b").alias("b_ids"))
    many_b = (F.size("a") == 1) & (F.size("b") > 1)
    many_a = (F.size("a") > 1) & (F.size("b") == 1)
    rows = rows.withColumns({"n_a": F.size("a"), "n_b": F.size("b"), "a_core": F.get("a", F.lit(0)), "b_core": F.get("b", F.lit(0))})
    rows = rows.withColumn("target", F.when(many_b, F.col("a_core")).when(many_a, F.col("b_core")).otherwise(F.lit("")))
    pieces = F.when(many_b, F.col("b")).when(many_a, F.col("a")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("best", T.best_concat_match(F.col("target"), pieces)).withColumn("pair", T.similarity(F.col("a_core"), F.col("b_core")))
    one = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    rows = rows.withColumns(
        {"similarity": F.when(one, F.col("pair")).when(many_a | many_b, F.col("best.score")).otherwise(0.0), "joined": F.when(one, F.col("b_core")).otherwise(F.col("best.joined"))}
    )
    named = rows.withColumn("category", category())
    exact = F.col("category").isin("exact_duplicate", "group_duplicate")
    return named.select(page, "component", "a_ids", "b_ids", "category", F.when(exact, 1.0).otherwise(F.col("similarity")).alias("similarity"), "joined")


def apply_components(a: DataFrame, b: DataFrame, components: DataFrame, page: str = "page_id") -> DataFrame:
    """Annotations (page, source, id, text, merge_reason): merged, excluded or kept.

    In a duplicate component every row of the second source is kept once with
    the reason; the first source's rows are dropped. Ambiguous components leave
    out both sides. All other rows are kept under their own source.
    """
    used = components.filter(F.col("category").isin(*MERGED, *AMBIGUOUS))
    gone = lambda ids: used.select(page, F.explode(ids).alias("id"))
    merged = components.filter(F.col("category").isin(*MERGED)).select(page, F.explode("b_ids").alias("id"), F.col("category").alias("merge_reason"))
    shape = lambda f, source: f.select(page, F.lit(source).alias("source"), "id", "text", F.col("merge_reason") if "merge_reason" in f.columns else F.lit(None).cast("string").alias("merge_reason"))
    kept_a = a.join(gone("a_ids"), [page, "id"], "left_anti")
    kept_b = b.join(gone("b_ids"), [page, "id"], "left_anti")
    return shape(b.join(merged, [page, "id"]), "merged").unionByName(shape(kept_a, "first")).unionByName(shape(kept_b, "second"))


def fixture_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of texts and bodies (as a second source) of the derived views."""
    from inkframe.operators.graph import page_components
    from inkframe.plans.geometry_queries import _overlap_edges

    a, b = fixture_sources(spark, folder)
    found = page_components(_overlap_edges(spark, folder), "page_id", "t_region_id", "b_region_id")
    texts = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).withColumnRenamed("id", "member")
    return classify(found.join(texts, ["page_id", "side", "member"]))


def fixture_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, id, text) of both sources."""
    from inkframe.plans.fixtures import regions
    from inkframe.session import table

    names = table(spark, folder, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("text"))
    rows = regions(spark, folder).join(names, "part_key").select("page_id", F.col("region_id").alias("id"), "cls", "text")
    return tuple(rows.filter(F.col("cls") == c).drop("cls") for c in ("text", "body"))


def fixture_annotations(spark: SparkSession, folder: str) -> DataFrame:
    from inkframe.session import scratch

    a, b = fixture_sources(spark, folder)
    path = scratch(spark, "components")  # three joins read them; they are found and classified once
    fixture_components(spark, folder).write.parquet(path)
    return apply_components(a, b, spark.read.parquet(path))
