"""Outer page joins, ordered candidates, repeated trials, pooled vectors, parameter and regression checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import checks, matching, metrics, ranking, vectors
from inkframe.plans import fixtures as X
from inkframe.plans.registry import query
from inkframe.session import table, written

R, E, I = X.REGION_SQL, X.EDGE_SQL, X.INSTANCE_SQL
SEED = 3407


@query(
    f"""WITH {R}, f AS (SELECT page_id, list(region_id ORDER BY region_id) AS l FROM region WHERE cls = 'face' GROUP BY page_id), g AS (SELECT page_id, list(region_id ORDER BY region_id) AS l FROM region WHERE cls = 'frame' GROUP BY page_id)
SELECT coalesce(f.page_id, g.page_id) AS page_id, coalesce(f.l, []) AS first, coalesce(g.l, []) AS second FROM f FULL OUTER JOIN g ON g.page_id = f.page_id"""
)
def outer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages of either of two sources; the missing side is an empty list."""
    rows = X.regions(spark, folder).select("page_id", "region_id", "cls")
    return matching.outer_pages(rows.filter("cls = 'face'"), rows.filter("cls = 'frame'"), "page_id", "region_id")


@query(
    """WITH r AS (SELECT p_brand, p_partkey, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_size % 5, p_type ORDER BY p_retailprice DESC, p_partkey) > 1 AS again FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY again, p_retailprice DESC, p_partkey) AS place FROM r) SELECT p_brand, place, p_partkey FROM o WHERE place <= 40"""
)
def diverse_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations of each group, one of each structure first, then the rest, cut to forty."""
    rows = table(spark, folder, "part").withColumn("structure", F.col("p_size") % 5)
    found = ranking.diverse_first(rows, ["p_brand"], ["structure", "p_type"], [F.desc("p_retailprice"), "p_partkey"], 40)
    return found.select("p_brand", "place", "p_partkey")


_UNIT = "list_transform(list(x ORDER BY p), lambda v: v / greatest(sqrt(list_sum(list_transform(list(x ORDER BY p), lambda y: y * y))), 1e-12))"


@query(
    f"""WITH {I}, o AS (SELECT i.*, trial, size, count(*) OVER (PARTITION BY trial, size, book, label) AS n, row_number() OVER (PARTITION BY trial, size, book, label ORDER BY md5(({SEED} + trial) || '|' || vec_id), vec_id) AS r FROM inst i, range(3) t(trial), (SELECT unnest([1, 3]) AS size)),
b AS (SELECT *, r <= least(size, n - 1) AS bank FROM o WHERE n > 1),
gm AS (SELECT trial, size, book, label, p, avg(vec[p]) AS x FROM b, range(1, 65) t(p) WHERE bank GROUP BY ALL), g AS (SELECT trial, size, book, label, {_UNIT} AS proto FROM gm GROUP BY ALL),
tm AS (SELECT trial, size, book, label, input_type, p, avg(vec[p]) AS x FROM b, range(1, 65) t(p) WHERE bank GROUP BY ALL), y AS (SELECT trial, size, book, label, input_type, {_UNIT} AS own FROM tm GROUP BY ALL),
s AS (SELECT k.strategy, q.trial, q.size, q.vec_id, q.label, g.label AS c, round(list_inner_product(q.vec, CASE WHEN k.strategy = 'modality' THEN coalesce(y.own, g.proto) ELSE g.proto END), 9) AS score
  FROM b q JOIN g ON g.trial = q.trial AND g.size = q.size AND g.book = q.book LEFT JOIN y ON y.trial = q.trial AND y.size = q.size AND y.book = q.book AND y.label = g.label AND y.input_type = q.input_type, (SELECT unnest(['mean', 'modality']) AS strategy) k WHERE NOT q.bank),
h AS (SELECT *, row_number() OVER (PARTITION BY strategy, trial, size, vec_id ORDER BY score DESC, c) AS r FROM s),
t AS (SELECT strategy, trial, size, avg(CASE WHEN c = label THEN 1.0 ELSE 0.0 END) AS rank1 FROM h WHERE r = 1 GROUP BY ALL)
SELECT strategy, CAST(size AS BIGINT) AS size, round(avg(rank1), 6) AS mean, round(stddev_pop(rank1), 6) AS std, round(min(rank1), 6) AS least, round(max(rank1), 6) AS most, count(*) AS trials FROM t GROUP BY ALL"""
)
def bank_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated gallery draws over bank sizes and strategies, summarised over trials."""
    found = vectors.bank_trials(X.instances(spark, folder), "book", "label", "input_type", "vec_id", "vec", SEED, 3, (1, 3), ("mean", "modality"))
    return metrics.trial_summary(found, ["strategy", "size"], "rank1")


@query(
    f"""WITH {I}, t AS (SELECT vec_id, [1.0, vec_id % 2, CASE WHEN vec_id % 3 > 0 THEN 1.0 ELSE 0.0 END, 0.0]::DOUBLE[] AS m, vec FROM inst),
s AS (SELECT vec_id, p, (vec[p] * m[1] + vec[16 + p] * m[2] + vec[32 + p] * m[3] + vec[48 + p] * m[4]) / greatest(list_sum(m), 1) AS x FROM t, range(1, 17) r(p)),
n AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM s GROUP BY vec_id) SELECT s.vec_id, CAST(p AS BIGINT) AS position, round(x / n, 6) AS value FROM s JOIN n ON n.vec_id = s.vec_id"""
)
def pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Means of the token vectors that a mask keeps, scaled to length 1."""
    rows = X.instances(spark, folder)
    tokens = F.array(*(F.slice("vec", 1 + 16 * i, 16) for i in range(4)))
    mask = F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double"), (F.col("vec_id") % 3 > 0).cast("double"), F.lit(0.0))
    pooled = rows.select("vec_id", F.posexplode(vectors.masked_mean(tokens, mask)).alias("p", "value"))
    return pooled.select("vec_id", (F.col("p") + 1).alias("position"), "value")


@query(
    """WITH q AS (SELECT event_id, ['merge_threshold', 'retries', 'image_size', 'top_k'][(event_id % 4 + 1)::INT] AS name, value FROM events)
SELECT event_id, name, CASE name WHEN 'merge_threshold' THEN 'merge_threshold must be between 0.0 and 1.0' WHEN 'retries' THEN 'retries must be at least 1.0' WHEN 'image_size' THEN 'image_size must be at least 64.0' ELSE 'top_k must be at most 5.0' END AS message
FROM q WHERE NOT coalesce(CASE name WHEN 'merge_threshold' THEN value BETWEEN 0 AND 1 WHEN 'retries' THEN value >= 1 WHEN 'image_size' THEN value >= 64 ELSE value <= 5 END, false)"""
)
def parameter_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters outside their range."""
    name = F.element_at(F.array(*map(F.lit, ("merge_threshold", "retries", "image_size", "top_k"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, folder, "events").select("event_id", name.alias("name"), "value")
    limits = {"merge_threshold": (0.0, 1.0), "retries": (1.0, None), "image_size": (64.0, None), "top_k": (None, 5.0)}
    return checks.out_of_range(rows, "name", "value", limits).select("event_id", "name", "message")


@query(
    f"""WITH {E}, t AS (SELECT page_id % 25 AS part, (page_id // 25) % 2 = 0 AS stored, query, arg_max(label, [score, -candidate]) AS top1 FROM edge GROUP BY ALL),
f AS (SELECT part, stored, avg(CASE WHEN top1 THEN 1.0 ELSE 0.0 END) AS rate FROM t GROUP BY part, stored)
SELECT a.part, round(a.rate, 6) AS rate, round(b.rate, 6) AS expected FROM f a JOIN f b ON b.part = a.part AND b.stored AND NOT a.stored WHERE abs(a.rate - b.rate) > 0.02"""
)
def regression_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Recomputed top-1 rates that differ from those stored by an earlier run, here a run over other pages of each part."""
    best = F.max(F.struct("score", (-F.col("candidate")).alias("c"), "label"))["label"]
    pages = X.edges(spark, folder).withColumns({"part": F.col("page_id") % 25, "stored": F.expr("(page_id div 25) % 2 = 0")})
    rates = pages.groupBy("part", "stored", "query").agg(best.alias("top1")).groupBy("part", "stored").agg(F.avg(F.col("top1").cast("int")).alias("rate"))
    kept = written(rates.filter("stored").select("part", F.col("rate").alias("expected")), "rates")
    return checks.regressions(rates.filter("NOT stored").select("part", "rate"), kept, ["part"], "rate", 0.02).select("part", "rate", "expected")
