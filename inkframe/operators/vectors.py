"""Norms, prototypes, nearest prototypes and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators.sampling import repeated_trials


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row; what a lambda's body names is computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    """Length 1; the norm is 1e-12 at least."""
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return bound(v, lambda x: bound(norm(x), lambda n: F.transform(x, lambda value: value / n)))


def prototypes(frame: DataFrame, group: list[str], vec: str) -> DataFrame:
    """Normalised mean vector of each group. Positions are averaged apart, so partial sums are combined before the shuffle."""
    flat = frame.select(*group, F.posexplode(F.col(vec).cast("array<double>")).alias("p", "x"))
    means = flat.groupBy(*group, "p").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    listed = means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("l"), F.max("n").alias("members"))
    return listed.select(*group, "members", unit(F.transform("l", lambda s: s["x"])).alias("prototype"))


def scores(queries: DataFrame, bank: DataFrame, book: str, vec: str) -> DataFrame:
    """Cosine of each query with each prototype of its book. The bank is small; Spark broadcasts it if its size allows."""
    return queries.join(bank, book).withColumn("score", dot(F.col(vec), F.col("prototype")))


def modality_scores(queries: DataFrame, typed: DataFrame, overall: DataFrame, book: str, identity: str, kind: str, vec: str) -> DataFrame:
    """Scores with the prototype of the query's own input type where the identity has one, else with the overall one."""
    pairs = queries.join(overall.select(book, identity, F.col("prototype").alias("__all")), book)
    some = typed.select(book, identity, kind, F.col("prototype").alias("__own"))
    joined = pairs.join(some, [book, identity, kind], "left")
    return joined.withColumn("score", dot(F.col(vec), F.coalesce("__own", "__all"))).drop("__own", "__all")


def nearest_prototype(scored: DataFrame, key: list[str], identity: str, least: float | None = None) -> DataFrame:
    """The best identity of each query (the smaller one at ties), unknown (null) under ``least``."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), identity)
    best = scored.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    if least is None:
        return best
    return best.withColumn(identity, F.when(F.col("score") >= least, F.col(identity)))


def gallery_split(frame: DataFrame, group: list[str], key: str, seed: int, gallery: int) -> DataFrame:
    """Role of each row of an identity: up to min(gallery, n-1) gallery rows in the order of a hash, the rest queries.

    Identities with one row are left out. The order is md5(seed|key), the same
    in every engine.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    w = Window.partitionBy(*group)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(draw, key))
    rows = frame.withColumns({"__n": n, "__r": r}).filter("__n > 1")
    role = F.when(F.col("__r") <= F.least(F.lit(gallery), F.col("__n") - 1), "gallery").otherwise("query")
    return rows.withColumn("role", role).drop("__n", "__r")


def retrieval(split: DataFrame, book: str, identity: str, key: str, vec: str) -> DataFrame:
    """Rank-1, rank-5 and mean average precision of each book over its gallery instances."""
    g = split.filter("role = 'gallery'").select(book, F.col(identity).alias("gi"), F.col(key).alias("gk"), F.col(vec).alias("gv"))
    q = split.filter("role = 'query'").select(book, F.col(identity).alias("qi"), F.col(key).alias("qk"), F.col(vec).alias("qv"))
    pairs = q.join(g, book).select(book, "qi", "qk", "gi", "gk", F.round(dot(F.col("qv"), F.col("gv")), 9).alias("score"))
    order = Window.partitionBy(book, "qk").orderBy(F.desc("score"), "gk")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("hit", (F.col("qi") == F.col("gi")).cast("int"))
    ranked = ranked.withColumn("hits", F.sum("hit").over(order))
    per = ranked.groupBy(book, "qk").agg(
        F.max(F.when((F.col("rank") <= 1), F.col("hit")).otherwise(0)).alias("r1"),
        F.max(F.when((F.col("rank") <= 5), F.col("hit")).otherwise(0)).alias("r5"),
        (F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))) / F.greatest(F.sum("hit"), F.lit(1))).alias("ap"),
    )
    return per.groupBy(book).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("r1").alias("rank1"), F.avg("r5").alias("rank5"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("map")
    )


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps, scaled to length 1; without any, zeros."""
    kept = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x * m))
    first = F.get(kept, F.lit(0))
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), first, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))
    return unit(F.transform(total, lambda x: x / n))


def bank_trials(frame: DataFrame, book: str, identity: str, kind: str, key: str, vec: str, seed: int, trials: int, sizes: tuple[int, ...], strategies: tuple[str, ...]) -> DataFrame:
    """Rank-1 rates of repeated gallery draws: one row per trial, bank size and strategy.

    In each trial min(size, n - 1) rows of an identity, in the order of
    md5(seed + trial|key), are its gallery. ``mean`` scores by the gallery's
    prototype, ``modality`` by that of the query's own input type if there is one.
    """
    unknown = set(strategies) - {"mean", "modality"}
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    grid = ["trial", "size"]
    rows = repeated_trials(frame, trials, sizes, ("any",)).drop("strategy")
    draw = F.md5(F.concat((F.col("trial") + seed).cast("string"), F.lit("|"), F.col(key).cast("string")))
    w = Window.partitionBy(*grid, book, identity)
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(draw, key))}).filter("__n > 1")
    rows = rows.withColumn("__bank", F.col("__r") <= F.least(F.col("size"), F.col("__n") - 1))
    gallery = rows.filter("__bank")
    overall = prototypes(gallery, [*grid, book, identity], vec).select(*grid, book, F.col(identity).alias("__c"), F.col("prototype").alias("__all"))
    typed = prototypes(gallery, [*grid, book, identity, kind], vec).select(*grid, book, F.col(identity).alias("__c"), kind, F.col("prototype").alias("__own"))
    pairs = rows.filter("NOT __bank").select(*grid, book, identity, kind, key, F.col(vec).alias("__v")).join(overall, [*grid, book]).join(typed, [*grid, book, "__c", kind], "left")
    scored = pairs.select("*", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    proto = F.when(F.col("strategy") == "modality", F.coalesce("__own", "__all")).otherwise(F.col("__all"))
    best = F.max(F.struct(F.round(dot(F.col("__v"), proto), 9).alias("s"), (-F.col("__c")).alias("c")))
    each = scored.groupBy("strategy", *grid, book, key, identity).agg((-best["c"]).alias("__found"))
    return each.groupBy("strategy", *grid).agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("__found") == F.col(identity)).cast("int")).alias("rank1"))


def medoids(frame: DataFrame, bank: DataFrame, group: list[str], key: str, vec: str) -> DataFrame:
    """The member nearest to each prototype, the smaller key at ties."""
    scored = frame.join(bank, group).withColumn("__s", dot(F.col(vec), F.col("prototype")))
    best = F.max(F.struct(F.col("__s"), (-F.col(key)).alias("k")))
    return scored.groupBy(*group).agg((-best["k"]).alias("medoid"))


def identity_candidates(queries: DataFrame, frame: DataFrame, bank: DataFrame, medoid: DataFrame, book: str, cluster: str, key: str, vec: str, k: int = 5) -> DataFrame:
    """The k most similar clusters of each query, each shown by an example other than the query itself.

    The example is the cluster's medoid. If that is the query, it is the other
    member most similar to the query; a cluster with no other is skipped.
    """
    asked = queries.select(book, F.col(key).alias("query"), F.col(vec).alias("qv"))
    scored = asked.join(bank, book).withColumn("score", dot(F.col("qv"), F.col("prototype"))).join(medoid, [book, cluster])
    own = scored.filter(F.col("medoid") == F.col("query"))
    others = own.join(frame.select(book, cluster, F.col(key).alias("other"), F.col(vec).alias("ov")), [book, cluster]).filter("other <> query")
    closest = F.max(F.struct(dot(F.col("qv"), F.col("ov")).alias("s"), (-F.col("other")).alias("o")))
    replaced = others.groupBy(book, "query", cluster).agg((-closest["o"]).alias("__other"))
    shown = scored.join(replaced, [book, "query", cluster], "left")
    example = F.when(F.col("medoid") == F.col("query"), F.col("__other")).otherwise(F.col("medoid"))
    usable = shown.withColumn("example", example).filter("example IS NOT NULL")
    order = Window.partitionBy(book, "query").orderBy(F.desc("score"), cluster)
    return usable.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(book, "query", "rank", cluster, "example", "score")


def library_assignment(frame: DataFrame, bank: DataFrame, book: str, cluster: str, key: str, vec: str, member: str) -> DataFrame:
    """Library members keep their cluster; the others take the nearest prototype's. ``source`` says which."""
    scored = frame.select(book, key, F.col(cluster).alias("__own"), member, F.col(vec).alias("__v")).join(bank, book)
    scored = scored.withColumn("score", dot(F.col("__v"), F.col("prototype")))
    best = nearest_prototype(scored, [book, key], cluster)
    keep = F.coalesce(F.col(member), F.lit(False))
    return best.select(
        book,
        key,
        F.when(keep, F.col("__own")).otherwise(F.col(cluster)).alias(cluster),
        F.when(keep, "library").otherwise("retrieved").alias("source"),
        "score",
    )


def signature(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of a group's rows in order."""
    entry = F.struct(F.col(order).alias("__o"), *columns)
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(*(s[c].alias(c) for c in columns)))
    return rows.groupBy(*group).agg(F.sha2(F.to_json(listed), 256).alias("signature"))


def fuse(scored: DataFrame, prior: DataFrame, on: list[str], weight: float = 6.0) -> DataFrame:
    """Add a weighted prior to scores; queries without one fall back to the score."""
    joined = scored.join(prior.select(*on, "prior"), on, "left")
    return joined.withColumn("fused", F.col("score") + F.lit(weight) * F.coalesce("prior", F.lit(0.0))).withColumn(
        "source", F.when(F.col("prior").isNotNull(), "tail_fusion").otherwise("fallback")
    )
