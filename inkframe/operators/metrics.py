"""Ranking, retrieval and clustering metrics, counts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(top: Column, bottom: Column, empty: float) -> Column:
    """top / bottom, or ``empty`` if bottom is 0 or null."""
    return F.when(F.coalesce(bottom, F.lit(0)) > 0, top / bottom).otherwise(F.lit(empty))


def percentile(value: Column, p: float) -> Column:
    """Linearly interpolated percentile (p from 0 to 100); 0 without values."""
    return F.coalesce(F.percentile(value, p / 100), F.lit(0.0))


def length_summary(frame: DataFrame, split: str, length: Column) -> DataFrame:
    """count, min, max and percentiles per split and over all (split ``all``), in one pass."""
    rows = frame.select(F.col(split).alias("split"), length.alias("n"))
    both = rows.withColumn("split", F.explode(F.array(F.col("split"), F.lit("all"))))
    n = F.col("n")
    return both.groupBy("split").agg(
        F.count("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), *(percentile(n, p).alias(f"p{p}") for p in (50, 90, 95, 99))
    )


def over_lengths(length: Column, limits: tuple[int, ...] = (25, 32, 40, 48, 64, 80, 100)) -> list[Column]:
    """Counts of lengths over each limit."""
    return [F.count_if(length > limit).alias(f"over_{limit}") for limit in limits]


def first_examples(frame: DataFrame, key: list[str], order: str, value: str, n: int) -> DataFrame:
    """The first n values of each key in order."""
    w = Window.partitionBy(*key).orderBy(order)
    few = frame.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda s: s[value]).alias("examples"))


def feature_statistics(frame: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation of each position; the variance is 1e-8 at least."""
    flat = frame.select(F.posexplode(F.col(vec).cast("array<double>")).alias("position", "x"))
    variance = F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")
    return flat.groupBy("position").agg(F.avg("x").alias("mean"), F.sqrt(F.greatest(variance, F.lit(1e-8))).alias("std"))


def contingency(clusters: DataFrame, book: str, truth: str, pred: str) -> DataFrame:
    """Sparse table of truth by prediction."""
    return clusters.groupBy(book, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def clustering_metrics(clusters: DataFrame, book: str, truth: str, pred: str) -> DataFrame:
    """B-cubed, pairwise, ARI and NMI of each book from its contingency cells.

    Cells are few; the label sums are windows over cells, so the rows
    themselves are shuffled once, pre-aggregated.
    """
    cells = contingency(clusters, book, truth, pred)
    of = lambda *c: F.sum("n").over(Window.partitionBy(book, *c)).cast("double")
    cells = cells.withColumns({"a": of(truth), "b": of(pred), "total": of()})
    n, a, b, total = (F.col(c).cast("double") for c in ("n", "a", "b", "total"))
    pairs = lambda x: x * (x - 1) / 2
    entropy = lambda x: -(n / total) * F.log(x / total)
    sums = cells.groupBy(book).agg(
        F.max("total").alias("total"),
        F.sum(n * n / b / total).alias("b_precision"),
        F.sum(n * n / a / total).alias("b_recall"),
        F.sum(pairs(n)).alias("together"),
        F.sum(n * (b - 1) / 2).alias("predicted"),
        F.sum(n * (a - 1) / 2).alias("actual"),
        F.sum(n / total * F.log(n * total / (a * b))).alias("information"),
        F.sum(entropy(a)).alias("h_truth"),
        F.sum(entropy(b)).alias("h_pred"),
        F.count_distinct(pred).alias("clusters"),
        F.count_distinct(truth).alias("identities"),
    )
    c = F.col
    precision, recall = ratio(c("together"), c("predicted"), 1.0), ratio(c("together"), c("actual"), 1.0)
    expected = ratio(c("predicted") * c("actual"), pairs(c("total")), 0.0)
    best = (c("predicted") + c("actual")) / 2
    f = lambda p, r: ratio(2 * p * r, p + r, 0.0)
    return sums.select(
        book,
        c("total").cast("long").alias("instances"),
        "clusters",
        "identities",
        "b_precision",
        "b_recall",
        f(c("b_precision"), c("b_recall")).alias("b_f1"),
        precision.alias("pair_precision"),
        recall.alias("pair_recall"),
        f(precision, recall).alias("pair_f1"),
        ratio(1.25 * precision * recall, 0.25 * precision + recall, 0.0).alias("pair_f05"),
        F.when(best == expected, 1.0).otherwise((c("together") - expected) / (best - expected)).alias("ari"),
        (F.greatest(c("information"), F.lit(0.0)) / F.greatest((c("h_truth") + c("h_pred")) / 2, F.lit(1e-12))).alias("nmi"),
    )


def cluster_sizes(clusters: DataFrame, book: str, pred: str) -> DataFrame:
    """Clusters, singletons, the largest and its share, per book."""
    sizes = clusters.groupBy(book, pred).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(book).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("largest_ratio"),
    )


def listwise_metrics(edges: DataFrame, page: str, query: str, candidate: str, score: str, label: str) -> DataFrame:
    """Per query with a positive: top-1, top-3, reciprocal rank, recalls, F1, average precision, exactness."""
    order = Window.partitionBy(page, query).orderBy(F.desc(score), candidate)
    ranked = edges.select(page, query, candidate, score, F.col(label).cast("int").alias("hit"), F.row_number().over(order).alias("rank"))
    ranked = ranked.withColumn("hits", F.sum("hit").over(order))
    rank, hit = F.col("rank"), F.col("hit")
    at = lambda k: F.sum(F.when(rank <= k, hit).otherwise(0))
    total = F.sum("hit")
    return (
        ranked.groupBy(page, query)
        .agg(
            total.alias("positives"),
            at(1).alias("top1"),
            (at(3) > 0).cast("int").alias("top3"),
            (1 / F.min(F.when(hit == 1, rank))).alias("reciprocal_rank"),
            (at(1) / total).alias("recall1"),
            (at(3) / total).alias("recall3"),
            (2 * at(1) / (1 + total)).alias("f1_at1"),
            (F.sum(F.when(hit == 1, F.col("hits") / rank)) / total).alias("average_precision"),
            ((total == 1) & (at(1) == 1)).cast("int").alias("exact1"),
        )
        .filter("positives > 0")
    )


def listwise_summary(queries: DataFrame) -> DataFrame:
    """Macro averages over queries, and micro precision, recall and F1 of the first place."""
    n, hits, positives = F.count(F.lit(1)), F.sum("top1"), F.sum("positives")
    p, r = hits / F.greatest(n, F.lit(1)), hits / F.greatest(positives, F.lit(1))
    macro = ("top1", "top3", "reciprocal_rank", "recall1", "recall3", "f1_at1", "average_precision", "exact1")
    return queries.agg(
        n.alias("queries"),
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in macro),
        F.coalesce(p, F.lit(0.0)).alias("micro_precision"),
        F.coalesce(r, F.lit(0.0)).alias("micro_recall"),
        F.coalesce(ratio(2 * p * r, p + r, 0.0), F.lit(0.0)).alias("micro_f1"),
    )


def listwise_loss(edges: DataFrame, group: list[str], score: Column, label: str) -> DataFrame:
    """log-sum-exp of all scores minus that of the positive ones; queries without positives are errors (null)."""
    w = Window.partitionBy(*group)
    rows = edges.select(*group, F.col(label).alias("hit"), score.alias("s"), F.max(score).over(w).alias("m"))
    e = F.exp(F.col("s") - F.col("m"))
    sums = rows.groupBy(*group).agg(F.sum(e).alias("every"), F.sum(F.when(F.col("hit"), e)).alias("positive"))
    return sums.select(*group, (F.log("every") - F.log("positive")).alias("loss"))


def weighted(value: str, weight: str) -> Column:
    """Average of per-book values, weighted; 0 without weight."""
    return ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight), 0.0)


def trial_summary(trials: DataFrame, group: list[str], value: str) -> DataFrame:
    return trials.groupBy(*group).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("trials")
    )


def by_fixed_types(frame: DataFrame, group: str, kind: str, kinds: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """Aggregates per group and type with a row for every type; absent ones are 0."""
    wanted = frame.select(group).distinct().withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    found = frame.groupBy(group, kind).agg(*(v.alias(k) for k, v in values.items()))
    return wanted.join(found, [group, kind], "left").na.fill(0, list(values))


def compare_models(first: DataFrame, second: DataFrame, on: list[str], correct: str, choice: str) -> DataFrame:
    """Outcome of each query under two models, and whether they agree."""
    a = first.select(*on, F.col(correct).alias("a"), F.col(choice).alias("ca"))
    b = second.select(*on, F.col(correct).alias("b"), F.col(choice).alias("cb"))
    outcome = (
        F.when(F.col("a") & F.col("b"), "both_correct").when(~F.col("a") & F.col("b"), "corrected").when(F.col("a"), "regressed").otherwise("both_wrong")
    )
    return a.join(b, on).select(*on, outcome.alias("outcome"), F.col("ca").eqNullSafe(F.col("cb")).alias("agree"))


def win_loss(compared: DataFrame) -> DataFrame:
    """Counts of outcomes, agreement, net gain and both accuracies."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return compared.agg(
        *(n(x).alias(x) for x in ("both_correct", "corrected", "regressed", "both_wrong")),
        F.count_if("agree").alias("agreement"),
        (n("corrected") - n("regressed")).alias("net_gain"),
        (n("both_correct", "regressed") / total).alias("first_accuracy"),
        (n("both_correct", "corrected") / total).alias("second_accuracy"),
    )


def ablation(runs: DataFrame, expected: DataFrame, baseline: str) -> DataFrame:
    """Best epoch of every expected run and the difference to a baseline run, null for missing runs."""
    order = Window.partitionBy("run").orderBy(F.desc("metric"), "epoch")
    best = runs.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    base = best.agg(F.max(F.when(F.col("run") == baseline, F.col("metric"))).alias("__base"))  # one row
    return expected.join(best, "run", "left").crossJoin(F.broadcast(base)).withColumn("delta", F.col("metric") - F.col("__base")).drop("__base")
