"""Configurations of clustering: a sweep with its choice, an adaptive choice per book, and saved parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import cluster, graph, metrics
from inkframe.plans import fixtures as X
from inkframe.plans.registry import query
from inkframe.session import table, written

#: Thresholds that are tried, the books on which one is chosen, and what is allowed there. Fixed values.
THRESHOLDS = (0.25, 0.3, 0.35, 0.4, 0.45)
VALIDATION = (0, 1)
LARGEST = 0.6

_SWEPT = f"""WITH RECURSIVE {X.INSTANCE_SQL}, s AS (SELECT a.book, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) AS score FROM inst a JOIN inst b ON a.book = b.book AND a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s) WHERE r <= 5),
cfg AS (SELECT unnest(range(1, {len(THRESHOLDS) + 1})) AS config, unnest(CAST({list(THRESHOLDS)} AS DOUBLE[])) AS threshold),
e AS (SELECT config, x.a, x.b FROM nn x JOIN nn y ON y.a = x.b AND y.b = x.a JOIN cfg ON x.score >= threshold),
reach AS (SELECT config, vec_id AS node, vec_id AS root FROM inst, cfg UNION SELECT r.config, e.b, r.root FROM reach r JOIN e ON e.a = r.node AND e.config = r.config),
l AS (SELECT config, node, min(root) AS root FROM reach GROUP BY ALL),
cl AS MATERIALIZED (SELECT config, book, vec_id, label, root FROM inst JOIN l ON node = vec_id),
size AS (SELECT config, book, root, count(*) AS n FROM cl GROUP BY ALL),
shape AS MATERIALIZED (SELECT config, book, sum(n) AS instances, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) / sum(n) AS largest FROM size GROUP BY ALL)"""
_SWEEP = f"""{_SWEPT},
cell AS (SELECT config, book, label, root, count(*) AS n FROM cl WHERE book IN {VALIDATION} GROUP BY ALL),
pair AS (
  SELECT config, book, (SELECT sum(n * (n - 1) / 2) FROM cell c WHERE c.config = o.config AND c.book = o.book) AS together,
    (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM cell c WHERE c.config = o.config AND c.book = o.book GROUP BY root)) AS predicted,
    (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM cell c WHERE c.config = o.config AND c.book = o.book GROUP BY label)) AS actual FROM (SELECT DISTINCT config, book FROM cell) o),
w AS (
  SELECT config, sum(CASE WHEN predicted = 0 THEN 1 ELSE together / predicted END * instances) / sum(instances) AS p, sum(CASE WHEN actual = 0 THEN 1 ELSE together / actual END * instances) / sum(instances) AS r, max(largest) AS largest
  FROM pair JOIN shape USING (config, book) GROUP BY config),
f AS (SELECT *, round(p, 9) AS pp, round(1.25 * p * r / greatest(1e-12, 0.25 * p + r), 9) AS f05, largest <= {LARGEST} AS ok FROM w),
g AS (SELECT * FROM f WHERE ok OR NOT (SELECT bool_or(ok) FROM f))
SELECT config, threshold, round(p, 6) AS pair_precision, round(r, 6) AS pair_recall, round(f05, 6) AS pair_f05, round(largest, 6) AS largest, row_number() OVER (ORDER BY f05 DESC, pp DESC, threshold DESC, config) AS place FROM g JOIN cfg USING (config)"""


def swept(spark: SparkSession, folder: str) -> DataFrame:
    """config, book, vec_id, label and cluster under every threshold; neighbours are found once."""
    frame = written(X.instances(spark, folder).select("vec_id", "book", "label", "vec"), "instances")
    edges = graph.mutual_edges(graph.nearest_neighbours(frame, "book", "vec_id", "vec", 5), "book", "vec_id")
    configs = F.explode(F.array(*(F.struct(F.lit(i).alias("config"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS, 1))))
    both = lambda f: f.select("*", configs.alias("c")).withColumn("cb", F.struct("c.config", "book"))
    strong = both(edges).filter(F.col("score") >= F.col("c.threshold"))
    found = graph.threshold_clusters(both(frame.select("vec_id", "book")), strong, "cb", "vec_id", 0.0)
    return found.select("cb.config", "cb.book", "vec_id", "cluster").join(frame.select("vec_id", "label"), "vec_id")


def shapes(found: DataFrame) -> DataFrame:
    """config, book and what can be told of a clustering without labels."""
    sizes = metrics.cluster_sizes(found.withColumn("cb", F.struct("config", "book")), "cb", "cluster")
    return sizes.select("cb.config", "cb.book", "clusters", "singletons", F.col("largest_ratio").alias("largest"))


@query(_SWEEP)
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds ranked by weighted pair scores of the validation books, unusable ones left out if others are usable."""
    found = written(swept(spark, folder).filter(F.col("book").isin(*VALIDATION)), "swept")
    scored = metrics.clustering_metrics(found.withColumn("cb", F.struct("config", "book")), "cb", "label", "cluster")
    each = scored.select("cb.config", "cb.book", "instances", "pair_precision", "pair_recall").join(shapes(found), ["config", "book"])
    overall = each.groupBy("config").agg(*(metrics.weighted(c, "instances").alias(c) for c in ("pair_precision", "pair_recall")), F.max("largest").alias("largest"))
    p, r = F.col("pair_precision"), F.col("pair_recall")
    thresholds = F.element_at(F.array(*map(F.lit, THRESHOLDS)), F.col("config"))
    rows = overall.withColumns({"pair_f05": F.round(1.25 * p * r / F.greatest(F.lit(1e-12), 0.25 * p + r), 9), "pair_precision": F.round(p, 9), "threshold": thresholds})
    placed = cluster.select_configuration(rows, f"largest <= {LARGEST}", ["pair_f05", "pair_precision", "threshold"])
    return placed.select("config", "threshold", "pair_precision", "pair_recall", "pair_f05", "largest", "place")


@query(
    f"""{_SWEPT}, o AS (SELECT *, largest <= 0.1 AND singletons * 10 <= instances * 4 AS ok FROM shape WHERE book NOT IN {VALIDATION})
SELECT book, arg_min(config, CASE WHEN ok THEN [0, 0, 0, config] ELSE [1, largest, singletons, config] END) AS config, bool_or(ok) AS feasible FROM o GROUP BY book"""
)
def adaptive_books(spark: SparkSession, folder: str) -> DataFrame:
    """Each further book takes the first configuration whose clusters look usable, or the least risky, without labels."""
    found = swept(spark, folder).filter(~F.col("book").isin(*VALIDATION))
    counts = found.groupBy("config", "book").agg(F.count(F.lit(1)).alias("instances"))
    rows = shapes(found).join(counts, ["config", "book"])
    return cluster.adaptive_choice(rows, "book", "largest <= 0.1 AND singletons * 10 <= instances * 4", ["largest", "singletons"]).select("book", "config", "feasible")


@query(
    """WITH k AS (SELECT unnest(['assign', 'dimensions', 'margin', 'merge', 'method', 'min_cluster_size', 'min_samples']) AS name),
n AS (SELECT n_nationkey AS book, n_nationkey % 3 > 0 AS own FROM nation)
SELECT book, name, CASE name WHEN 'method' THEN CASE WHEN own AND book % 2 = 1 THEN 'leaf' ELSE 'eom' END WHEN 'dimensions' THEN CAST(CASE WHEN own THEN 8 + book ELSE 16 END AS VARCHAR)
  ELSE CAST(CASE WHEN own THEN book * 10 + length(name) ELSE length(name) END AS VARCHAR) END AS value FROM n, k"""
)
def saved_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """A book's saved parameters, else the overall ones; a missing key would be an error."""
    books = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("book"))
    text = lambda c: c.cast("string")

    def saved(number: Column, method: Column, dimensions: Column) -> Column:
        other = {k: F.length(F.lit(k)) + number for k in cluster.REQUIRED if k not in ("method", "dimensions")}
        pairs = {"method": method, "dimensions": text(dimensions), "epoch": F.lit("7"), **{k: text(v) for k, v in other.items()}}
        return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("parameters")

    book = F.col("book")
    own = books.filter("book % 3 > 0").select(book, saved(book * 10, F.when(book % 2 == 1, "leaf").otherwise("eom"), book + 8))
    overall = books.limit(1).select(F.lit(None).cast("long").alias("book"), saved(F.lit(0), F.lit("eom"), F.lit(16)))
    found = cluster.saved_parameters(books, own.unionAll(overall), "book")
    return found.select("book", F.explode("parameters").alias("name", "value"))
