"""Queries over texts, clusters, vectors, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions import answers, text as text_fn
from inkframe.operators import checks, cluster, curate, decide, density, graph, lifecycle, matching, metrics, ranking, review, sampling, vectors
from inkframe.plans import fixtures as X
from inkframe.plans import plugins
from inkframe.plans.geometry_queries import IH, IW, MEET, _pair_sql, features_45
from inkframe.plans.registry import SQL, query
from inkframe.plans.text_sql import SIMILARITY_SQL, components_sql
from inkframe.session import table, written
from inkframe.sources import writers

L, C, I = X.LABEL_TEXT_SQL, X.CLUSTER_SQL, X.INSTANCE_SQL
SEED = 3407


# ---- texts -------------------------------------------------------------------


@query(
    f"""WITH {L}, b AS (SELECT unnest([split, 'all']) AS split, length(replace(translate(text, chr(13) || chr(10), ''), chr(9), ' ')) AS n FROM label_text)
SELECT split, count(*) AS n, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90,
  round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM b GROUP BY split"""
)
def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """H3, H4, C4: lengths of cleaned labels per split and over all."""
    return metrics.length_summary(X.label_texts(spark, folder), "split", F.char_length(text_fn.clean_label(F.col("text"))))


@query(
    f"""WITH {L}, b AS (SELECT split, length(text) AS n FROM label_text)
SELECT split, count(*) AS n, {", ".join(f"count(*) FILTER (n > {k}) AS over_{k}" for k in (25, 32, 40, 48, 64, 80, 100))},
  round(count(*) FILTER (n > 100) / count(*), 6) AS long_ratio FROM b GROUP BY split"""
)
def over_length_counts(spark: SparkSession, folder: str) -> DataFrame:
    """H2, H1: labels over length limits per split."""
    n = F.char_length("text")
    return X.label_texts(spark, folder).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *metrics.over_lengths(n), (F.count_if(n > 100) / F.count(F.lit(1))).alias("long_ratio")
    )


@query(
    f"""WITH {L}, ch AS (SELECT unnest(string_split(text, '')) AS ch FROM label_text), f AS (SELECT ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY ch),
d AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)
SELECT f.ch, n, d.ch IS NOT NULL AS known, 'U+' || lpad(upper(to_hex(unicode(f.ch))), 4, '0') AS code FROM f LEFT JOIN d ON d.ch = f.ch"""
)
def charset_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Frequency of every character, and whether the dictionary has it."""
    ch = lambda f: f.select(F.explode(text_fn.characters(F.col("text"))).alias("ch"))
    known = ch(table(spark, folder, "benchmark")).distinct().withColumn("known", F.lit(True))
    counts = ch(X.label_texts(spark, folder)).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, "ch", "left").select("ch", "n", F.coalesce("known", F.lit(False)).alias("known"), text_fn.code_point(F.col("ch")).alias("code"))


@query(
    f"""WITH {L}, ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM label_text), d AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)
SELECT count(*) AS unknown_characters FROM ch WHERE ch <> '' AND ch NOT IN (SELECT ch FROM d)"""
)
def dict_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Characters outside the dictionary."""
    ch = lambda f: f.select(F.explode(text_fn.characters(F.col("text"))).alias("ch")).distinct()
    unknown = ch(X.label_texts(spark, folder)).join(ch(table(spark, folder, "benchmark")), "ch", "left_anti")
    return unknown.agg(F.count(F.lit(1)).alias("unknown_characters"))


@query(
    f"""WITH {L} SELECT split, count(*) FILTER (contains(text, chr(10)) OR contains(text, chr(13))) AS with_newline, count(*) FILTER (contains(text, chr(9))) AS with_tab,
  count(*) FILTER (trim(text) = '') AS empty, CAST(sum(length(replace(translate(text, chr(13) || chr(10), ''), chr(9), ' '))) AS BIGINT) AS characters FROM label_text GROUP BY split"""
)
def label_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What is odd about raw labels, per split."""
    rows = X.label_texts(spark, folder).withColumn("f", text_fn.label_flags(F.col("text")))
    return rows.groupBy("split").agg(
        F.count_if("f.has_newline").alias("with_newline"), F.count_if("f.has_tab").alias("with_tab"), F.count_if("f.is_empty").alias("empty"), F.sum("f.length").alias("characters")
    )


@query(
    """SELECT p_partkey AS id, regexp_replace(p_name, '[^0-9A-Za-z._-]+', '_', 'g') AS safe, replace(replace(p_brand || '/' || p_partkey, '/', '__'), '''', '_') || '.npz' AS cache,
  printf('images/%s/%03d.jpg', p_brand, p_partkey) AS image, p_brand || '::' || p_size AS identity, printf('%s/%03d/%s', p_brand, p_partkey, p_type) AS record,
  printf('%s:p%03d:component%03d', p_brand, p_partkey, p_size) AS component, lower(trim(p_name)) = 'other' AS other, printf('%.2f%%', p_size / 50 * 100) AS share FROM part"""
)
def ids_and_names(spark: SparkSession, folder: str) -> DataFrame:
    """File-safe names, keys and formatted shares."""
    key, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    return table(spark, folder, "part").select(
        key.alias("id"),
        text_fn.file_safe(F.col("p_name")).alias("safe"),
        text_fn.cache_filename(F.concat(brand, F.lit("/"), key.cast("string")), ".npz").alias("cache"),
        text_fn.image_path(brand, key).alias("image"),
        text_fn.identity_id(brand, size).alias("identity"),
        text_fn.record_key(brand, key, F.col("p_type")).alias("record"),
        text_fn.component_id(brand, key, size).alias("component"),
        text_fn.is_other(F.col("p_name")).alias("other"),
        text_fn.percent(size / 50).alias("share"),
    )


@query(
    """SELECT a.p_partkey AS a, b.p_partkey AS b, regexp_replace(a.p_name, '\\s+', '', 'g') AS a_text, contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name) AS contained
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""
)
def text_containment(spark: SparkSession, folder: str) -> DataFrame:
    """White space removed; mutual containment of neighbouring names."""
    part = table(spark, folder, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select(
        F.col("p_partkey").alias("a"), "b", text_fn.strip_space(F.col("p_name")).alias("a_text"), text_fn.either_contains(F.col("p_name"), F.col("other")).alias("contained")
    )


@query(SIMILARITY_SQL)
def text_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms, similarity and best concatenation of part names."""
    part = table(spark, folder, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = part.join(other, "p_partkey").withColumns({"x": text_fn.core_text(F.col("p_name")), "y": text_fn.core_text(F.col("other"))})
    best = pairs.withColumn("best", text_fn.best_concat_match(F.col("x"), F.split("other", " ")))
    return best.select("p_partkey", "x", text_fn.similarity(F.col("x"), F.col("y")).alias("similarity"), text_fn.guarded_similarity(F.col("p_name"), F.col("other")).alias("guarded"), "best.joined", "best.score")


@query(
    """SELECT doc_id, regexp_extract(text, '[0-9]+', 0) = '' AS no_digits, source FROM documents WHERE n_chars >= 100 AND source IN ('src0', 'src1') AND lang <> 'de'"""
)
def filters(spark: SparkSession, folder: str) -> DataFrame:
    """A threshold and a whitelist, pushed to the scan, and a flag that excludes."""
    rows = table(spark, folder, "documents").filter((F.col("n_chars") >= 100) & F.col("source").isin("src0", "src1"))
    flagged = rows.withColumn("excluded", F.col("lang") == "de").filter("NOT excluded")
    return flagged.select("doc_id", (F.regexp_extract("text", "[0-9]+", 0) == "").alias("no_digits"), "source")


# ---- roll-ups, splits and checks ---------------------------------------------------


@query(
    """SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY ROLLUP (lang, source)"""
)
def split_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level counts with totals."""
    rolled = table(spark, folder, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters"))
    return rolled.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "characters")


@query("""SELECT CAST(l_orderkey // 10 AS BIGINT) AS page, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def split_disjoint_check(spark: SparkSession, folder: str) -> DataFrame:
    """Members with more than one owner."""
    rows = table(spark, folder, "lineitem").select(F.expr("l_orderkey div 10").alias("page"), "l_returnflag")
    return checks.shared_members(rows, ["page"], "l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that occur more than once."""
    return checks.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) GROUP BY ALL""")
def dangling_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key is unknown."""
    known = table(spark, folder, "supplier").filter("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"))
    return checks.dangling(table(spark, folder, "lineitem"), known, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT l_returnflag AS kind, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT kind, count(*) AS n, array_to_string(list(l_orderkey ORDER BY r) FILTER (r <= 100), ',') AS examples FROM o GROUP BY kind"""
)
def error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Errors counted per kind with their first hundred examples."""
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("kind"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"), F.col("l_orderkey").alias("detail"))
    found = checks.error_report(rows, "kind", "o", "detail")
    return found.select("kind", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query(
    """SELECT a.o_orderkey, nullif(a.o_custkey % 3, 0) AS a_width, nullif(b.o_custkey % 4, 0) AS b_width FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey WHERE nullif(a.o_custkey % 3, 0) <> nullif(b.o_custkey % 4, 0)"""
)
def size_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Known sizes that differ; 0 is unknown."""
    size = lambda m: table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % m).alias("width"), F.lit(0).cast("long").alias("height"))
    return checks.size_conflicts(size(3), size(4), ["o_orderkey"]).select("o_orderkey", "a_width", "b_width")


@query(
    """SELECT vec_id FROM embeddings WHERE len(embedding) <> 64 OR list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x) < 1e30 THEN 0 ELSE 1 END)) > 0"""
)
def bad_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a wrong length or not finite."""
    return checks.bad_vectors(table(spark, folder, "embeddings"), "embedding", 64).select("vec_id")


@query(
    """SELECT conv_id, abs(max(turn) - min(turn)) > 3 AS apart, list(turn ORDER BY turn) = list(turn ORDER BY length(text), turn) AS same_order FROM conversations GROUP BY conv_id"""
)
def order_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered lists of two tables compared; numbers within a tolerance."""
    listed = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"), F.array(F.max("turn").cast("double")).alias("a"), F.array(F.min("turn").cast("double")).alias("b"))
    by_length = F.array_sort(F.collect_list(F.struct(F.char_length("text").alias("n"), "turn")))
    cached = table(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(by_length, lambda x: x["turn"]).alias("ids"))
    bad = checks.order_mismatch(listed, cached, ["conv_id"], "ids").select("conv_id", F.lit(True).alias("bad"))
    return listed.join(bad, "conv_id", "left").select("conv_id", checks.box_mismatch(F.col("a"), F.col("b"), 3.0).alias("apart"), F.col("bad").isNull().alias("same_order"))


@query("""SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_brand FROM part)""")
def dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values numbered from 0."""
    return sampling.dense_ids(table(spark, folder, "part"), "p_brand")


@query(
    """SELECT p_brand, 'both' AS side FROM (SELECT p_brand FROM part WHERE p_size < 5 INTERSECT SELECT p_brand FROM part WHERE p_size > 45)
UNION ALL SELECT p_brand, 'first' FROM (SELECT p_brand FROM part WHERE p_size < 5 EXCEPT SELECT p_brand FROM part WHERE p_size > 45)
UNION ALL SELECT p_brand, 'any' FROM (SELECT p_brand FROM part WHERE p_size < 5 UNION SELECT p_brand FROM part WHERE p_size > 45)"""
)
def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Intersection, difference and union of key sets, tagged."""
    part = table(spark, folder, "part")
    a, b = part.filter("p_size < 5").select("p_brand"), part.filter("p_size > 45").select("p_brand")
    tag = lambda f, side: f.withColumn("side", F.lit(side))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(a.union(b).distinct(), "any"))


@query(
    f"""WITH g AS (SELECT DISTINCT s_nationkey FROM supplier), n AS (SELECT s_nationkey, row_number() OVER (ORDER BY md5('{SEED}|' || s_nationkey), s_nationkey) AS r FROM g)
SELECT s_nationkey, CASE WHEN r <= 15 THEN 'train' WHEN r <= 20 THEN 'val' ELSE 'test' END AS split FROM n"""
)
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    """K1: groups split in hash order."""
    return sampling.group_split(table(spark, folder, "supplier"), "s_nationkey", SEED, 15, 5)


@query(
    f"""SELECT s_suppkey, row_number() OVER (ORDER BY md5('{SEED + 3}|' || s_suppkey), s_suppkey) AS place, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS BIGINT) AS chunk FROM supplier"""
)
def permutation(spark: SparkSession, folder: str) -> DataFrame:
    """K4, K8: an epoch's order; chunks of seven rows."""
    rows = sampling.permutation(table(spark, folder, "supplier").select("s_suppkey"), SEED, 3, "s_suppkey")
    numbered = sampling.range_numbers(rows, "s_suppkey", "n")
    return numbered.select("s_suppkey", "place", F.floor(F.col("n") / 7).alias("chunk"))


def _batches(orders: DataFrame) -> DataFrame:
    c = F.col("o_custkey")
    pages = orders.select(
        F.col("o_orderkey").alias("key"), F.lit(1600).alias("width"), (2000 + c % 400).alias("height"), (c % 9).alias("dialogues"), (c % 7).alias("candidates")
    )
    return sampling.bucketed_batches(pages, "key", SEED, 1, 4).select("key", "batch")


@query(
    f"""WITH p AS (SELECT o_orderkey AS key, 1600 AS width, 2000 + o_custkey % 400 AS height, o_custkey % 9 AS dialogues, o_custkey % 7 AS candidates FROM orders),
n AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED + 1}|' || key), key) - 1 AS n FROM p), q AS (SELECT *, n // 128 AS pool FROM n),
b AS (SELECT *, pool * 32 + (row_number() OVER (PARTITION BY pool ORDER BY round_even(8 * width / height, 0), dialogues * candidates, candidates, n) - 1) // 4 AS b FROM q)
SELECT key, CAST(dense_rank() OVER (ORDER BY md5('{SEED + 1}|batch|' || b), b) - 1 AS BIGINT) AS batch FROM b"""
)
def bucketed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """K5: batches of pages of like shape."""
    return _batches(table(spark, folder, "orders"))


@query(
    f"""WITH m AS (SELECT s_nationkey, list(s_suppkey ORDER BY md5('{SEED}|' || s_suppkey), s_suppkey) AS m, row_number() OVER (ORDER BY md5('{SEED + 1}|' || s_nationkey), s_nationkey) - 1 AS n FROM supplier GROUP BY s_nationkey)
SELECT CAST(n // 4 AS BIGINT) AS batch, s_nationkey, m[i % len(m) + 1] AS s_suppkey FROM m, range(3) t(i)"""
)
def identity_batches(spark: SparkSession, folder: str) -> DataFrame:
    """K6: batches of four identities with three members each."""
    return sampling.identity_batches(table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", SEED, 4, 3)


# ---- sequences and events --------------------------------------------------------------


@query(
    """SELECT conv_id, turn, lag(text) OVER w AS previous, text AS current, lead(text) OVER w AS next,
  [lag(turn) OVER w IS NOT NULL, true, lead(turn) OVER w IS NOT NULL] AS mask FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def prev_next_context(spark: SparkSession, folder: str) -> DataFrame:
    """Previous, current and next text with a mask."""
    return ranking.context(table(spark, folder, "conversations"), "conv_id", "turn", "text")


@query(
    """SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM conversations WHERE turn % 3 <> 1"""
)
def recent_context(spark: SparkSession, folder: str) -> DataFrame:
    """The last five accepted texts before each accepted one."""
    found = ranking.recent(table(spark, folder, "conversations"), "conv_id", "turn", "text", F.col("turn") % 3 != 1)
    return found.select("conv_id", "turn", F.when(F.size("recent") > 0, F.col("recent")).alias("recent"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, value FROM events),
s AS (SELECT user_id, event_id, exp((value - max(value) OVER g) / 10) / greatest(sum(exp((value - m) / 10)) OVER g, 1e-12) AS share FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM e) WINDOW g AS (PARTITION BY user_id))
SELECT event_id, round(share, 6) AS share FROM s"""
)
def softmax_share(spark: SparkSession, folder: str) -> DataFrame:
    """I8: share of each value among its user's."""
    return table(spark, folder, "events").select("event_id", ranking.softmax_share(["user_id"], F.col("value") / 10).alias("share"))


@query(
    """SELECT user_id, round(max(CASE WHEN r = 1 THEN value END) - max(CASE WHEN r = 2 THEN value END), 6) AS margin FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2 GROUP BY user_id"""
)
def top1_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Best minus second best."""
    return ranking.top_margin(table(spark, folder, "events"), ["user_id"], "value", "event_id")


@query(
    """SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type ORDER BY n DESC, first LIMIT 3"""
)
def most_common(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent types, first seen first at ties."""
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(3)


_EPOCH = "epoch AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, round(value) AS metric FROM events)"


@query(
    f"""WITH {_EPOCH} SELECT e.run, CAST(max(epoch) - max(CASE WHEN metric >= b THEN epoch END) AS BIGINT) AS epochs_since_best FROM epoch e JOIN (SELECT run, max(metric) AS b FROM epoch GROUP BY run) m ON m.run = e.run GROUP BY e.run"""
)
def epochs_since_best(spark: SparkSession, folder: str) -> DataFrame:
    """Epochs after the last one that reached the best metric."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    history = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.round("value").alias("metric"))
    return ranking.epochs_since_best(history, "run", "epoch", "metric")


@query(
    f"""WITH {_EPOCH}, d AS (SELECT DISTINCT epoch FROM epoch)
SELECT epoch, round(CASE WHEN epoch <= 5 THEN epoch / 5 * 0.001 ELSE 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(least(1.0, (epoch - 5) / 45) * pi())) END, 6) AS rate FROM d"""
)
def learning_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Linear warm-up, then cosine decay, for every epoch that some run reached."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    epochs = table(spark, folder, "events").select(F.row_number().over(w).cast("long").alias("epoch")).distinct()
    return epochs.select("epoch", ranking.learning_rate(F.col("epoch"), 0.001, 5, 50, 0.00001).alias("rate"))


@query(
    f"""WITH {_EPOCH}, b AS (SELECT run, epoch, metric, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS r FROM epoch),
x AS (SELECT unnest(range(CAST(max(user_id) + 11 AS BIGINT))) AS run FROM events)
SELECT x.run, b.epoch, b.metric, b.metric - (SELECT metric FROM b WHERE r = 1 AND run = 20) AS delta FROM x LEFT JOIN b ON b.run = x.run AND r = 1"""
)
def ablation_table(spark: SparkSession, folder: str) -> DataFrame:
    """Best epoch of each expected run and its difference to a baseline."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.round("value").alias("metric"))
    last = table(spark, folder, "events").agg(F.max("user_id")).first()[0] or 0  # ten runs that are missing are listed, too
    return metrics.ablation(runs, spark.range(0, last + 11).withColumnRenamed("id", "run"), 20)


# ---- decisions and edits ---------------------------------------------------------------

_RESPONSE = """resp AS (SELECT event_id, event_type AS type, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'true' WHEN 3 THEN 'high' WHEN 4 THEN '1.5' WHEN 5 THEN '85%'
   ELSE CAST((event_id % 100) / 100 AS VARCHAR) END AS raw FROM events)"""


def _raw_confidence() -> F.Column:
    m = F.col("event_id") % 11
    fixed = {0: None, 1: "", 2: "true", 3: "high", 4: "1.5", 5: "85%"}
    value = F.when(m == 0, F.lit(None).cast("string"))
    for k, v in list(fixed.items())[1:]:
        value = value.when(m == k, v)
    return value.otherwise(((F.col("event_id") % 100) / 100).cast("string"))


@query(
    f"""WITH {_RESPONSE}, n AS (SELECT *, try_cast(CASE WHEN suffix(trim(raw), '%') THEN left(trim(raw), len(trim(raw)) - 1) ELSE trim(raw) END AS DOUBLE) / CASE WHEN suffix(trim(raw), '%') THEN 100 ELSE 1 END AS v FROM resp)
SELECT event_id, CASE WHEN raw NOT IN ('true') AND v BETWEEN 0 AND 1 THEN round(v, 6) END AS value,
  CASE WHEN raw IS NULL THEN 'confidence is missing' WHEN trim(raw) = '' THEN 'confidence is empty' WHEN lower(raw) IN ('true', 'false') THEN 'confidence must be numeric, not boolean'
    WHEN v IS NULL THEN 'confidence is not numeric' WHEN NOT v BETWEEN 0 AND 1 THEN 'confidence is outside [0, 1]' END AS error FROM n"""
)
def confidence_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Strict confidences with the reason of each failure."""
    rows = table(spark, folder, "events").select("event_id", answers.confidence(_raw_confidence(), "confidence").alias("c"))
    return rows.select("event_id", "c.value", "c.error")


@query(
    """WITH r AS (SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events), a AS (SELECT event_id, k, CASE WHEN k % 7 = 6 THEN 'unknown' ELSE substr('ABCDEF', CAST(k % 7 + 1 AS INT), 1) END AS choice FROM r)
SELECT event_id, CASE WHEN choice <> 'unknown' AND position(choice IN 'ABCD') > 0 THEN position(choice IN 'ABCD') - 1 END AS "index",
  round(CASE WHEN choice <> 'unknown' AND position(choice IN 'ABCD') > 0 THEN CASE WHEN k > 1 AND k <= 100 THEN k / 100 ELSE least(1.0, k) END ELSE 0.0 END, 6) AS confidence,
  CASE WHEN choice <> 'unknown' AND position(choice IN 'ABCD') = 0 THEN 'unsupported choice: ' || choice END AS error FROM a"""
)
def option_parse(spark: SparkSession, folder: str) -> DataFrame:
    """A lettered choice and its confidence out of free-form answers."""
    k = F.get_json_object("props", "$.k").cast("long")
    choice = F.when(k % 7 == 6, "unknown").otherwise(F.substring(F.lit("ABCDEF"), (k % 7 + 1).cast("int"), F.lit(1)))
    answer = F.format_string('Sure: {"choice": "%s", "confidence": %d} done', choice, k)
    rows = table(spark, folder, "events").select("event_id", answers.option(answer, F.lit(4)).alias("o"))
    return rows.select("event_id", "o.index", "o.confidence", "o.error")


_VLM = """v AS (SELECT event_id, event_id % 13 <> 0 AS has_response, CASE event_type WHEN 'error' THEN 'narration' WHEN 'view' THEN 'sound_effect' ELSE 'dialogue' END AS type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 50 + 51) / 100 END AS type_confidence, event_id % 4 <> 0 AS requires_link, (event_id % 40 + 61) / 100 AS link_confidence,
  CASE WHEN event_id % 9 = 0 THEN 'OFFSCREEN' ELSE 'B1' END AS choice, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 30 + 71) / 100 END AS speaker_confidence,
  event_id % 5 <> 0 AS has_evidence, event_id % 9 <> 0 AND event_id % 6 <> 0 AS choice_valid FROM events)"""


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        (i % 13 != 0).alias("has_response"),
        F.when(kind == "error", "narration").when(kind == "view", "sound_effect").otherwise("dialogue").alias("type"),
        F.when(i % 11 != 0, (i % 50 + 51) / 100).alias("type_confidence"),
        (i % 4 != 0).alias("requires_link"),
        ((i % 40 + 61) / 100).alias("link_confidence"),
        F.when(i % 9 == 0, "OFFSCREEN").otherwise("B1").alias("choice"),
        F.when(i % 7 != 0, (i % 30 + 71) / 100).alias("speaker_confidence"),
        (i % 5 != 0).alias("has_evidence"),
        ((i % 9 != 0) & (i % 6 != 0)).alias("choice_valid"),
    )


_DECISION = """CASE WHEN NOT has_response THEN 'fallback'
  WHEN type IN ('narration', 'sound_effect') AND NOT requires_link AND coalesce(type_confidence, -1) >= 0.8 AND link_confidence >= 0.8 THEN 'filtered_non_dialogue'
  WHEN NOT requires_link OR link_confidence < 0.8 OR coalesce(type_confidence, -1) < 0.8 THEN 'fallback'
  WHEN choice = 'OFFSCREEN' AND coalesce(speaker_confidence, -1) >= 0.8 AND has_evidence THEN 'offscreen'
  WHEN NOT choice_valid OR coalesce(speaker_confidence, -1) < 0.8 OR NOT has_evidence THEN 'fallback' ELSE 'accepted' END"""


@query(f"WITH {_VLM} SELECT event_id, {_DECISION} AS status FROM v")
def decision_status(spark: SparkSession, folder: str) -> DataFrame:
    """The panel decision table."""
    return _responses(spark, folder).select("event_id", decide.panel_decision(0.80).alias("status"))


@query(
    f"""WITH {_VLM} SELECT CASE WHEN has_response AND choice_valid AND coalesce(speaker_confidence, -1) >= 0.7 THEN 'accepted' ELSE 'fallback' END AS identity,
  CASE WHEN has_response AND choice_valid AND coalesce(speaker_confidence, -1) >= 0.7 THEN 'accepted' ELSE 'unknown' END AS strict, count(*) AS n FROM v GROUP BY ALL"""
)
def identity_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Identity decisions, with fallback and the older with unknown."""
    rows = _responses(spark, folder).withColumnRenamed("speaker_confidence", "confidence")
    return rows.groupBy(decide.identity_decision(0.70).alias("identity"), decide.strict_decision(0.70).alias("strict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_VLM}, s AS (SELECT event_id, event_id // 100 AS page, {_DECISION} AS status FROM v)
SELECT CASE WHEN page < 10 THEN status ELSE 'not_reviewed' END AS status, count(*) AS n, count(DISTINCT page) AS pages FROM s GROUP BY 1"""
)
def review_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Page limit and counters of a run."""
    rows = _responses(spark, folder).select(F.expr("event_id div 100").alias("page"), decide.panel_decision(0.80).alias("status"))
    return decide.limited_review(rows, "page", 10).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"))


@query(
    f"""WITH {_VLM}, s AS (SELECT event_id, {_DECISION} AS status FROM v)
SELECT event_id, CASE WHEN status = 'accepted' THEN 'B1' WHEN status IN ('offscreen', 'filtered_non_dialogue') THEN NULL ELSE 'v' || event_id % 5 END AS speaker,
  CASE WHEN status <> 'fallback' THEN 'v' || event_id % 5 END AS speaker_before FROM s"""
)
def marked_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and unknown rows overwrite the speaker; the first value is kept."""
    status = decide.panel_decision(0.80)
    rows = _responses(spark, folder).withColumns({"status": status, "speaker": F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))})
    unknown = F.col("status").isin("offscreen", "filtered_non_dialogue")
    return decide.apply_choice(rows, F.col("status") == "accepted", unknown, {"speaker": F.col("choice")}).select("event_id", "speaker", "speaker_before")


_EVAL = f"""WITH {_VLM}, s AS (SELECT event_id, type = 'dialogue' AS is_dialogue, CASE WHEN {_DECISION} = 'accepted' THEN event_id % 4 END AS predicted, CASE WHEN event_id % 8 <> 7 THEN event_id % 3 END AS truth, event_id % 6 <> 5 AS in_top5 FROM v)"""


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id")
    rows = _responses(spark, folder).withColumn("ok", decide.panel_decision(0.80) == "accepted")
    return rows.select(
        "event_id",
        (F.col("type") == "dialogue").alias("is_dialogue"),
        F.col("ok").alias("accepted"),
        F.when(F.col("ok"), i % 4).alias("predicted"),
        F.when(i % 8 != 7, i % 3).alias("truth"),
        (i % 6 != 5).alias("in_top5"),
        (i % 2 == 0).alias("is_exact"),
        ((i % 10) / 10).alias("similarity"),
    )


@query(
    f"""{_EVAL} SELECT CASE WHEN NOT is_dialogue THEN 'not_dialogue' WHEN predicted IS NULL THEN 'unknown' WHEN predicted = truth THEN 'correct' ELSE 'wrong' END AS category, count(*) AS n FROM s GROUP BY 1"""
)
def audit_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Audit category counts."""
    return _evaluated(spark, folder).groupBy(decide.audit_category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_EVAL} SELECT count(*) AS texts, count(*) FILTER (is_dialogue) AS dialogues, round(count(*) FILTER (event_id % 2 = 0) / greatest(count(*), 1), 6) AS exact_rate,
  round(sum(event_id % 10 / 10) / greatest(count(*), 1), 6) AS mean_similarity,
  round(count(*) FILTER (is_dialogue AND predicted = truth) / greatest(count(*) FILTER (is_dialogue AND truth IS NOT NULL), 1), 6) AS top1_recall,
  round(count(*) FILTER (is_dialogue AND truth IS NOT NULL AND in_top5) / greatest(count(*) FILTER (is_dialogue AND truth IS NOT NULL), 1), 6) AS top5_recall,
  round(count(*) FILTER (predicted IS NOT NULL AND is_dialogue AND predicted = truth) / greatest(count(*) FILTER (predicted IS NOT NULL AND is_dialogue AND truth IS NOT NULL), 1), 6) AS accepted_precision,
  round(count(*) FILTER (is_dialogue AND truth IS NOT NULL AND predicted IS NULL) / greatest(count(*) FILTER (is_dialogue AND truth IS NOT NULL), 1), 6) AS unknown_rate FROM s"""
)
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """End-to-end rates."""
    return decide.evaluation_summary(_evaluated(spark, folder))


@query(
    """WITH log AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'restore' END AS action, 'cluster_' || lpad(CAST(event_id % 17 AS VARCHAR), 3, '0') AS target FROM events),
last AS (SELECT id, arg_max(action, seq) AS action, arg_max(target, seq) AS target FROM log GROUP BY id)
SELECT s_suppkey AS id, CASE action WHEN 'delete' THEN 'unassigned' WHEN 'move' THEN target ELSE 'cluster_' || lpad(CAST(s_suppkey % 12 AS VARCHAR), 3, '0') END AS cluster,
  CASE action WHEN 'delete' THEN false WHEN 'move' THEN true ELSE s_suppkey % 3 <> 0 END AS member FROM supplier LEFT JOIN last ON id = s_suppkey"""
)
def edit_log_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The edit log folded over the instances, last writer wins."""
    return review.fold_edits(_instances(spark, folder), _edits(spark, folder), "id", "seq").select("id", "cluster", "member")


def _instances(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("s_suppkey")
    name = F.format_string("cluster_%03d", i % 12)
    return table(spark, folder, "supplier").select(i.alias("id"), name.alias("cluster"), (i % 3 != 0).alias("member"), F.concat(F.lit("name "), (i % 12).cast("string")).alias("name"), (i % 10 == 0).alias("excluded"))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.when(kind == "click", "move").when(kind == "error", "delete").otherwise("restore").alias("action"),
        F.format_string("cluster_%03d", F.col("event_id") % 17).alias("target"),
    )


_INST = "ins AS (SELECT s_suppkey AS id, 'cluster_' || lpad(CAST(s_suppkey % 12 AS VARCHAR), 3, '0') AS cluster, s_suppkey % 3 <> 0 AS member, 'name ' || s_suppkey % 12 AS name FROM supplier)"


@query(f"WITH {_INST} SELECT id, CASE cluster WHEN 'cluster_003' THEN 'cluster_001' WHEN 'cluster_004' THEN 'cluster_001' ELSE cluster END AS cluster, CASE WHEN cluster IN ('cluster_003', 'cluster_004') THEN 'name 1' ELSE name END AS name FROM ins")
def merged_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters merged into a target that gives its name."""
    mapping = spark.createDataFrame([("cluster_003", "cluster_001"), ("cluster_004", "cluster_001")], "source string, target string")
    return review.merge_clusters(_instances(spark, folder), mapping).select("id", "cluster", "name")


@query(f"WITH {_INST} SELECT id, cluster, CASE cluster WHEN 'cluster_002' THEN 'Ann' WHEN 'cluster_005' THEN 'cluster_005' ELSE name END AS name FROM ins")
def renamed_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Bulk rename by cluster; a blank name is the id."""
    names = spark.createDataFrame([("cluster_002", " Ann "), ("cluster_005", "  ")], "cluster string, name string")
    return review.rename(_instances(spark, folder), names).select("id", "cluster", "name")


@query(f"WITH {_INST} SELECT 'cluster_' || lpad(CAST(max(CAST(right(cluster, 3) AS INT)) + 1 AS VARCHAR), 3, '0') AS next, count(*) AS instances, count(DISTINCT cluster) AS clusters, count(*) FILTER (member) AS members, 0 AS unassigned FROM ins")
def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The next cluster id and counts after an edit."""
    rows = _instances(spark, folder)
    return review.summary(rows).crossJoin(F.broadcast(review.next_cluster(rows)))  # one row each


# ---- clusterings -------------------------------------------------------------------------


@query(f"WITH {C} SELECT book, truth, pred, count(*) AS n FROM clu GROUP BY ALL")
def contingency(spark: SparkSession, folder: str) -> DataFrame:
    """H9: truth by prediction."""
    return metrics.contingency(X.predicted_clusters(spark, folder), "book", "truth", "pred")


_CELLS = f"""WITH {C}, cells AS (SELECT book, truth, pred, count(*)::DOUBLE AS n FROM clu GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY book, truth) AS a, sum(n) OVER (PARTITION BY book, pred) AS b, sum(n) OVER (PARTITION BY book) AS t FROM cells)"""


@query(
    f"""{_CELLS}, m AS (SELECT book, sum(n * n / b / t) AS p, sum(n * n / a / t) AS r FROM w GROUP BY book)
SELECT book, round(p, 6) AS b_precision, round(r, 6) AS b_recall, round(2 * p * r / (p + r), 6) AS b_f1 FROM m"""
)
def bcubed(spark: SparkSession, folder: str) -> DataFrame:
    """B-cubed scores."""
    return metrics.clustering_metrics(X.predicted_clusters(spark, folder), "book", "truth", "pred").select("book", "b_precision", "b_recall", "b_f1")


_PAIRS = f"""{_CELLS}, m AS (SELECT book, max(t) AS t, sum(n * (n - 1) / 2) AS tp, sum(n * (b - 1) / 2) AS pp, sum(n * (a - 1) / 2) AS ap FROM w GROUP BY book)"""


@query(
    f"""{_PAIRS} SELECT book, round(tp / pp, 6) AS pair_precision, round(tp / ap, 6) AS pair_recall, round(2 * (tp / pp) * (tp / ap) / (tp / pp + tp / ap), 6) AS pair_f1,
  round(1.25 * (tp / pp) * (tp / ap) / (0.25 * (tp / pp) + tp / ap), 6) AS pair_f05 FROM m"""
)
def pairwise_f(spark: SparkSession, folder: str) -> DataFrame:
    """Pairwise scores and F0.5."""
    found = metrics.clustering_metrics(X.predicted_clusters(spark, folder), "book", "truth", "pred")
    return found.select("book", "pair_precision", "pair_recall", "pair_f1", "pair_f05")


@query(f"{_PAIRS} SELECT book, round((tp - pp * ap / (t * (t - 1) / 2)) / ((pp + ap) / 2 - pp * ap / (t * (t - 1) / 2)), 6) AS ari FROM m")
def ari(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted Rand index."""
    return metrics.clustering_metrics(X.predicted_clusters(spark, folder), "book", "truth", "pred").select("book", "ari")


@query(
    f"""{_CELLS}, m AS (SELECT book, sum(n / t * ln(n * t / (a * b))) AS i, sum(-(n / t) * ln(a / t)) AS ha, sum(-(n / t) * ln(b / t)) AS hb FROM w GROUP BY book)
SELECT book, round(i / greatest((ha + hb) / 2, 1e-12), 6) AS nmi FROM m"""
)
def nmi(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised mutual information."""
    return metrics.clustering_metrics(X.predicted_clusters(spark, folder), "book", "truth", "pred").select("book", "nmi")


@query(
    f"""WITH {C}, s AS (SELECT book, pred, count(*) AS n FROM clu GROUP BY ALL)
SELECT book, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_ratio FROM s GROUP BY book"""
)
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster counts and the largest share."""
    return metrics.cluster_sizes(X.predicted_clusters(spark, folder), "book", "pred")


@query(
    f"""WITH {C}, c AS (SELECT book, pred, truth, count(*) AS votes, min(vec_id) AS first FROM clu GROUP BY ALL)
SELECT book, pred, truth, votes FROM (SELECT *, row_number() OVER (PARTITION BY book, pred ORDER BY votes DESC, first) AS r FROM c) WHERE r = 1"""
)
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The identity of each cluster."""
    return graph.majority_vote(X.predicted_clusters(spark, folder), ["book", "pred"], "truth", "vec_id")


@query(
    f"""WITH {C}, s AS (SELECT book, pred, count(*) AS n, min(vec_id) AS least FROM clu GROUP BY ALL), r AS (SELECT book, pred, row_number() OVER (PARTITION BY book ORDER BY n DESC, least) AS stable FROM s)
SELECT vec_id, c.book, c.pred, stable FROM clu c JOIN r ON r.book = c.book AND r.pred = c.pred"""
)
def stable_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters numbered by size."""
    return graph.stable_labels(X.predicted_clusters(spark, folder), "book", "pred", "vec_id").select("vec_id", "book", "pred", "stable")


@query(
    f"""WITH {C}, m AS (SELECT book, pred, round(avg(truth), 6) AS v, count(*) AS n FROM clu GROUP BY ALL)
SELECT pred, round(sum(v * n) / sum(n), 6) AS weighted, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most, count(*) AS trials FROM m GROUP BY pred"""
)
def weighted_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted and plain summaries over books."""
    per = X.predicted_clusters(spark, folder).groupBy("book", "pred").agg(F.round(F.avg("truth"), 6).alias("v"), F.count(F.lit(1)).alias("n"))
    plain = metrics.trial_summary(per, ["pred"], "v")
    return per.groupBy("pred").agg(metrics.weighted("v", "n").alias("weighted")).join(plain, "pred")


@query(
    f"""WITH {I}, k AS (SELECT unnest(['face+body', 'body-only', 'face-only', 'none']) AS input_type), b AS (SELECT DISTINCT book FROM inst)
SELECT b.book, k.input_type, count(vec_id) AS n, count(DISTINCT label) AS identities FROM b CROSS JOIN k LEFT JOIN inst i ON i.book = b.book AND i.input_type = k.input_type GROUP BY ALL"""
)
def by_input_type(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by input type with zero rows."""
    values = {"n": F.count(F.lit(1)), "identities": F.count_distinct("label")}
    return metrics.by_fixed_types(X.instances(spark, folder), "book", "input_type", ("face+body", "body-only", "face-only", "none"), values)


# ---- vectors -------------------------------------------------------------------------------

_PROTO = f"""{I},
mean AS (SELECT book, label, p, avg(vec[p]) AS x FROM inst, range(1, 65) t(p) GROUP BY ALL),
proto AS (SELECT book, label, list_transform(list(x ORDER BY p), lambda v: v / greatest(sqrt(list_sum(list_transform(list(x ORDER BY p), lambda y: y * y))), 1e-12)) AS prototype FROM mean GROUP BY book, label)"""


@query(
    f"""WITH {I} SELECT CAST(p - 1 AS BIGINT) AS position, round(avg(vec[p]), 6) AS mean, round(sqrt(greatest(avg(vec[p] * vec[p]) - avg(vec[p]) * avg(vec[p]), 1e-8)), 6) AS std FROM inst, range(1, 65) t(p) GROUP BY p"""
)
def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    """H7: mean and deviation of each position."""
    return metrics.feature_statistics(X.instances(spark, folder), "vec")


@query(f"WITH {_PROTO} SELECT book, label, CAST(p AS BIGINT) AS position, round(prototype[p], 6) AS value FROM proto, range(1, 65) t(p)")
def prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """H8, L1: normalised mean vectors of identities."""
    found = vectors.prototypes(X.instances(spark, folder), ["book", "label"], "vec")
    return found.select("book", "label", F.posexplode("prototype").alias("p", "value")).select("book", "label", (F.col("p") + 1).alias("position"), "value")


@query(
    f"""WITH {_PROTO}, s AS (SELECT vec_id, i.book, p.label, list_inner_product(vec, prototype) AS score FROM inst i JOIN proto p ON p.book = i.book),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
SELECT vec_id, book, CASE WHEN score >= 0.4 THEN label END AS label, round(score, 6) AS score FROM b WHERE r = 1"""
)
def nearest_prototype(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest identity of each vector, unknown under 0.4."""
    frame = X.instances(spark, folder)
    bank = vectors.prototypes(frame, ["book", "label"], "vec")
    scored = vectors.scores(frame.select("vec_id", "book", "vec"), bank, "book", "vec")
    return vectors.nearest_prototype(scored, ["vec_id"], "label", 0.4).select("vec_id", "book", "label", "score")


@query(
    f"""WITH {_PROTO}, tm AS (SELECT book, label, input_type, p, avg(vec[p]) AS x FROM inst, range(1, 65) t(p) GROUP BY ALL),
tp AS (SELECT book, label, input_type, list_transform(list(x ORDER BY p), lambda v: v / greatest(sqrt(list_sum(list_transform(list(x ORDER BY p), lambda y: y * y))), 1e-12)) AS own FROM tm GROUP BY ALL),
s AS (SELECT vec_id, i.book, p.label, list_inner_product(vec, coalesce(own, prototype)) AS score FROM inst i JOIN proto p ON p.book = i.book LEFT JOIN tp ON tp.book = i.book AND tp.label = p.label AND tp.input_type = i.input_type),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
SELECT vec_id, book, label, round(score, 6) AS score FROM b WHERE r = 1"""
)
def modality_aware(spark: SparkSession, folder: str) -> DataFrame:
    """L3: prototypes of the query's own input type where the identity has one."""
    frame = X.instances(spark, folder)
    overall = vectors.prototypes(frame, ["book", "label"], "vec")
    typed = vectors.prototypes(frame, ["book", "label", "input_type"], "vec").select("book", "label", "input_type", "prototype")
    scored = vectors.modality_scores(frame.select("vec_id", "book", "input_type", "vec"), typed, overall, "book", "label", "input_type", "vec")
    return vectors.nearest_prototype(scored, ["vec_id"], "label").select("vec_id", "book", "label", "score")


_SPLIT = f"""{I}, o AS (SELECT *, count(*) OVER (PARTITION BY book, label) AS n, row_number() OVER (PARTITION BY book, label ORDER BY md5('{SEED}|' || vec_id), vec_id) AS r FROM inst),
sp AS (SELECT *, CASE WHEN r <= least(3, n - 1) THEN 'gallery' ELSE 'query' END AS role FROM o WHERE n > 1)"""


@query(f"WITH {_SPLIT} SELECT vec_id, book, label, role FROM sp")
def gallery_split(spark: SparkSession, folder: str) -> DataFrame:
    """K2: gallery and query rows of each identity."""
    return vectors.gallery_split(X.instances(spark, folder), ["book", "label"], "vec_id", SEED, 3).select("vec_id", "book", "label", "role")


@query(
    f"""WITH {_SPLIT}, p AS (SELECT q.book, q.vec_id AS qk, q.label = g.label AS hit, g.vec_id AS gk, round(list_inner_product(q.vec, g.vec), 9) AS score FROM sp q JOIN sp g ON g.book = q.book AND g.role = 'gallery' WHERE q.role = 'query'),
r AS (SELECT *, row_number() OVER (PARTITION BY book, qk ORDER BY score DESC, gk) AS rank FROM p), h AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY book, qk ORDER BY rank) AS hits FROM r),
a AS (SELECT book, qk, max(CASE WHEN hit AND rank <= 1 THEN 1 ELSE 0 END) AS r1, max(CASE WHEN hit AND rank <= 5 THEN 1 ELSE 0 END) AS r5,
   coalesce(sum(CASE WHEN hit THEN hits / rank END), 0) / greatest(sum(CASE WHEN hit THEN 1 ELSE 0 END), 1) AS ap FROM h GROUP BY ALL)
SELECT book, count(*) AS queries, round(avg(r1), 6) AS rank1, round(avg(r5), 6) AS rank5, round(avg(ap), 6) AS map FROM a GROUP BY book"""
)
def gallery_query_map(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval over gallery instances."""
    split = vectors.gallery_split(X.instances(spark, folder), ["book", "label"], "vec_id", SEED, 3)
    return vectors.retrieval(split, "book", "label", "vec_id", "vec")


@query(
    f"""WITH {_SPLIT}, gm AS (SELECT book, label, p, avg(vec[p]) AS x FROM sp, range(1, 65) t(p) WHERE role = 'gallery' GROUP BY ALL),
gp AS (SELECT book, label, list_transform(list(x ORDER BY p), lambda v: v / greatest(sqrt(list_sum(list_transform(list(x ORDER BY p), lambda y: y * y))), 1e-12)) AS prototype FROM gm GROUP BY book, label),
s AS (SELECT q.book, q.vec_id, q.label = g.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.vec, g.prototype) DESC, g.label) AS rank FROM sp q JOIN gp g ON g.book = q.book WHERE q.role = 'query'),
f AS (SELECT book, vec_id, min(rank) AS rank FROM s WHERE hit GROUP BY ALL)
SELECT book, count(*) AS queries, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS rank1, round(avg(1 / rank), 6) AS mrr FROM f GROUP BY book"""
)
def prototype_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Few-shot prototypes of the gallery, rank metrics of the queries per book."""
    split = vectors.gallery_split(X.instances(spark, folder), ["book", "label"], "vec_id", SEED, 3)
    bank = vectors.prototypes(split.filter("role = 'gallery'"), ["book", "label"], "vec").withColumnRenamed("label", "candidate")
    asked = split.filter("role = 'query'").select("vec_id", "book", "label", "vec")
    scored = vectors.scores(asked, bank, "book", "vec").withColumn("hit", F.col("label") == F.col("candidate"))
    per = metrics.listwise_metrics(scored, "book", "vec_id", "candidate", "score", "hit")
    return per.groupBy("book").agg(F.count(F.lit(1)).alias("queries"), F.avg("top1").alias("rank1"), F.avg("reciprocal_rank").alias("mrr"))


@query(
    f"""WITH {I}, s AS (SELECT a.book, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) AS score FROM inst a JOIN inst b ON a.book = b.book AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s), n AS (SELECT * FROM k WHERE r <= 5)
SELECT x.book, x.a AS "left", x.b AS "right", round(x.score, 6) AS score FROM n x JOIN n y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b"""
)
def mutual_knn(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that are among each other's five nearest."""
    near = graph.nearest_neighbours(X.instances(spark, folder), "book", "vec_id", "vec", 5)
    return graph.mutual_edges(near, "book", "vec_id")


@query(
    f"""WITH RECURSIVE {I}, s AS (SELECT a.book, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) AS score FROM inst a JOIN inst b ON a.book = b.book AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s), n AS (SELECT * FROM k WHERE r <= 5),
e AS (SELECT x.a, x.b FROM n x JOIN n y ON y.a = x.b AND y.b = x.a WHERE x.score >= 0.35),
reach AS (SELECT vec_id AS node, vec_id AS root FROM inst UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node), l AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT i.book, i.vec_id, dense_rank() OVER (PARTITION BY i.book ORDER BY root) - 1 AS cluster FROM inst i JOIN l ON l.node = i.vec_id"""
)
def threshold_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the mutual neighbour graph from a cosine of 0.35."""
    frame = X.instances(spark, folder)
    edges = graph.mutual_edges(graph.nearest_neighbours(frame, "book", "vec_id", "vec", 5), "book", "vec_id")
    return graph.threshold_clusters(frame, edges, "book", "vec_id", 0.35)


@query()
def book_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of each book by the size-adaptive protocol."""
    return density.cluster_vectors(X.instances(spark, folder), "book", "vec_id", "vec", "book")


@query()
def hdbscan_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Density clusters of each book, noise as singletons."""
    return density.cluster_vectors(X.instances(spark, folder), "book", "vec_id", "vec", "hdbscan", min_cluster_size=3, min_samples=2, method="leaf")


@query()
def cluster_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of configurations, the adaptive choice per book and the metrics of that choice."""
    frame = X.instances(spark, folder)
    grid = [cluster.Parameters(d, 3, n, m) for d in (8, 16) for n, m in ((2, "eom"), (3, "leaf"))]
    swept = density.sweep(frame, "book", "vec_id", "vec", grid)
    sizes = swept.withColumn("key", F.concat_ws("|", "config", "book"))
    found = metrics.cluster_sizes(sizes, "key", "cluster")
    diagnostics = found.select(F.split("key", "\\|")[0].cast("int").alias("config"), F.split("key", "\\|")[1].cast("long").alias("book"), "clusters", "singletons", "largest_ratio")
    chosen = written(cluster.adaptive_choice(diagnostics, "book", "largest_ratio <= 0.5", ["largest_ratio", "singletons"]), "chosen")
    best = swept.join(chosen, ["book", "config"]).join(frame.select("vec_id", "label"), "vec_id")
    scored = metrics.clustering_metrics(best, "book", "label", "cluster")
    return chosen.join(scored.select("book", "clusters", "b_f1", "ari"), "book")


@query(
    f"""WITH {_PROTO}, s AS (SELECT i.book, i.vec_id, i.label AS own, p.label, list_inner_product(i.vec, p.prototype) AS score FROM inst i JOIN proto p ON p.book = i.book),
m AS (SELECT book, label, vec_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY book, label ORDER BY score DESC, vec_id) AS r FROM s WHERE own = label) WHERE r = 1),
o AS (SELECT q.book, q.vec_id, other FROM m JOIN inst q ON q.vec_id = m.medoid JOIN LATERAL (SELECT o.vec_id AS other FROM inst o WHERE o.book = m.book AND o.label = m.label AND o.vec_id <> q.vec_id ORDER BY list_inner_product(q.vec, o.vec) DESC, o.vec_id LIMIT 1) ON true),
e AS (SELECT s.book, s.vec_id AS query, s.label AS cluster, s.score, CASE WHEN m.medoid = s.vec_id THEN o.other ELSE m.medoid END AS example FROM s JOIN m ON m.book = s.book AND m.label = s.label LEFT JOIN o ON o.vec_id = s.vec_id)
SELECT book, query, rank, cluster, example, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY book, query ORDER BY score DESC, cluster) AS rank FROM e WHERE example IS NOT NULL) WHERE rank <= 5"""
)
def identity_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar identities of each vector with an example other than itself."""
    frame = X.instances(spark, folder).select("vec_id", "book", F.col("label").alias("cluster"), "vec")
    bank = vectors.prototypes(frame, ["book", "cluster"], "vec").select("book", "cluster", "prototype")
    medoid = vectors.medoids(frame, bank, ["book", "cluster"], "vec_id", "vec")
    return vectors.identity_candidates(frame, frame, bank, medoid, "book", "cluster", "vec_id", "vec")


@query(
    f"""WITH {I}, mean AS (SELECT book, label, p, avg(vec[p]) AS x FROM inst, range(1, 65) t(p) WHERE vec_id % 4 <> 0 GROUP BY ALL),
proto AS (SELECT book, label, list_transform(list(x ORDER BY p), lambda v: v / greatest(sqrt(list_sum(list_transform(list(x ORDER BY p), lambda y: y * y))), 1e-12)) AS prototype FROM mean GROUP BY book, label),
s AS (SELECT vec_id, i.book, i.label AS own, p.label, list_inner_product(vec, prototype) AS score FROM inst i JOIN proto p ON p.book = i.book), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
SELECT book, vec_id, CASE WHEN vec_id % 4 <> 0 THEN own ELSE label END AS label, CASE WHEN vec_id % 4 <> 0 THEN 'library' ELSE 'retrieved' END AS source, round(score, 6) AS score FROM b WHERE r = 1"""
)
def library_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Library members keep their cluster, others take the nearest."""
    frame = X.instances(spark, folder).withColumn("member", F.col("vec_id") % 4 != 0)
    bank = vectors.prototypes(frame.filter("member"), ["book", "label"], "vec").select("book", "label", "prototype")
    return vectors.library_assignment(frame, bank, "book", "label", "vec_id", "vec", "member")


@query(
    """SELECT conv_id, sha256('[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']') AS signature FROM conversations GROUP BY conv_id"""
)
def cache_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Signature of a group's ordered inputs."""
    return vectors.signature(table(spark, folder, "conversations"), ["conv_id"], "turn", ["turn", "role"])


@query(f"SELECT page_id, query, candidate, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, query ORDER BY score DESC, candidate) AS r FROM (SELECT page_id, query, candidate, round(4.0 * f26 - 6.0 * f14 - 2.0 * f17 + f36, 9) AS score FROM ({SQL['pair_features_45']}))) WHERE r = 1")
def ranked_by_plugin(spark: SparkSession, folder: str) -> DataFrame:
    """M3, M4, 2.R: candidates scored by the built-in ranker over the 45 features, the best of each text."""
    rounded = F.transform("features", lambda x: F.round(x, 9))  # as the query of the features gives them
    edges = features_45(spark, folder).withColumn("features", rounded).withColumn("text", F.lit(""))
    scored = plugins.score_queries(edges, ["page_id", "query"], "candidate", "features", "text", "linear")
    scored = scored.withColumn("score", F.round("score", 9))
    return ranking.top_k(scored, ["page_id", "query"], "score", "candidate", 1).select("page_id", "query", "candidate", "score")


# ---- curation, jobs and sinks ------------------------------------------------------------------


_CLASSED = f"WITH RECURSIVE {components_sql(_pair_sql(), f'{MEET} AND {IW} * {IH} / least(t_w * t_h, b_w * b_h) >= 0.35')}"


@query(f"{_CLASSED} SELECT category, count(*) AS n, round(avg(similarity), 6) AS similarity FROM classed GROUP BY category")
def component_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of the overlap components of two text sources."""
    return curate.fixture_components(spark, folder).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("similarity"))


@query(
    f"""{_CLASSED}, taken AS (SELECT unnest(a_ids) AS id, CAST(NULL AS VARCHAR) AS reason, category FROM classed UNION ALL SELECT unnest(b_ids), category, category FROM classed),
used AS (SELECT * FROM taken WHERE category IN ('exact_duplicate', 'near_duplicate', 'group_duplicate', 'near_group_duplicate', 'partial_overlap', 'complex_overlap', 'many_to_many')),
r AS (
  SELECT page_id, CASE WHEN cls = 'text' THEN 'first' ELSE 'second' END AS source, CAST(NULL AS VARCHAR) AS merge_reason FROM region JOIN part ON p_partkey = part_key WHERE cls IN ('text', 'body') AND region_id NOT IN (SELECT id FROM used)
  UNION ALL SELECT page_id, 'merged', reason FROM used JOIN region ON region_id = id WHERE reason IS NOT NULL AND category IN ('exact_duplicate', 'near_duplicate', 'group_duplicate', 'near_group_duplicate'))
SELECT source, merge_reason, count(*) AS n, count(DISTINCT page_id) AS pages FROM r GROUP BY ALL"""
)
def component_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations after merging duplicates, leaving out ambiguous ones and keeping the rest."""
    rows = curate.fixture_annotations(spark, folder)
    return rows.groupBy("source", "merge_reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query(
    """SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0"""
)
def resume(spark: SparkSession, folder: str) -> DataFrame:
    """What is still to do."""
    wanted = table(spark, folder, "supplier").select("s_suppkey")
    done = wanted.filter("s_suppkey % 3 = 0").withColumn("config", F.lit("v1"))
    return lifecycle.pending(wanted, done, ["s_suppkey"], "v1")


@query(
    """SELECT conv_id || chr(9) || '[' || string_agg('{"transcription":"' || role || '","points":[' || turn || ']}', ',' ORDER BY turn) || ']' AS value FROM conversations GROUP BY conv_id"""
)
def detector_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label lines of pages, JSON arrays in order."""
    rows = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("transcription"), F.array("turn").alias("points"))
    pages = rows.select("conv_id").distinct().withColumn("image", F.col("conv_id").cast("string"))
    return writers.detector_labels(pages, rows, "conv_id", "image")


@query(
    """WITH s AS (SELECT s_suppkey AS g, s_nationkey % 4 AS n FROM supplier), c AS (SELECT g, n, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s),
p AS (SELECT p_partkey AS position FROM part) SELECT position, g FROM p JOIN c ON position >= st AND position < st + n"""
)
def regrouped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """consecutive rows dealt to groups of given sizes."""
    sizes = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("g"), (F.col("s_nationkey") % 4).alias("n"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("position"))
    return matching.regroup(rows, sizes, "g", "position").select("position", "g")


@query(
    """SELECT s_suppkey AS id, 'tail' AS source FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'detector' FROM supplier WHERE s_suppkey % 2 = 1"""
)
def injected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """rows of one source replaced; twice gives the same."""
    base = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 1, "detector").otherwise("tail").alias("source"))
    fresh = table(spark, folder, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("id"))
    return matching.inject(matching.inject(base, fresh, "tail"), fresh, "tail")


@query(
    """SELECT l_orderkey, o_orderstatus, n_name, l_linenumber % 2 = 0 AS right_line, s_nationkey % 3 = 0 AS right_nation FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""
)
def chained_joins(spark: SparkSession, folder: str) -> DataFrame:
    """equi joins in a chain with two correctness flags."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    joined = lines.join(orders, "l_orderkey").join(suppliers, "l_suppkey").join(nations, "s_nationkey")
    return joined.select("l_orderkey", "o_orderstatus", "n_name", (F.col("l_linenumber") % 2 == 0).alias("right_line"), (F.col("s_nationkey") % 3 == 0).alias("right_nation"))


