"""Splits, draws and batches in a hash order that every engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: int, key: str) -> Column:
    """md5 of ``seed|key``: a fixed pseudo-random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def group_split(frame: DataFrame, group: str, seed: int, train: int, validation: int) -> DataFrame:
    """group and split: the first ``train`` groups in hash order, then ``validation``, the rest test.

    Distinct groups are numbered by ranges of their hash.
    """
    numbered = hash_numbers(frame.select(group).distinct(), hash_order(seed, group), group, "__n")
    return numbered.select(
        group, F.when(F.col("__n") < train, "train").when(F.col("__n") < train + validation, "val").otherwise("test").alias("split")
    )


def repeated_trials(frame: DataFrame, trials: int, sizes: tuple[int, ...], strategies: tuple[str, ...]) -> DataFrame:
    """Each row once per trial, bank size and strategy; the parameter table is explicit and small."""
    grid = F.array(*(F.struct(F.lit(t).alias("trial"), F.lit(n).alias("size"), F.lit(s).alias("strategy")) for t in range(trials) for n in sizes for s in strategies))
    return frame.select("*", F.inline(grid))


def hash_numbers(frame: DataFrame, order: Column, key: str, name: str) -> DataFrame:
    """Number rows from 0 by an MD5 and ``key``, without a task that holds all rows.

    The first three digits of the MD5 cut the order into 4096 ranges (and one of
    nulls); rows are numbered inside a range and moved by the sizes before it.
    """
    cut = frame.withColumn("__o", order).withColumn("__r", F.coalesce(F.substring("__o", 1, 3), F.lit("")))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__r").agg(F.count(F.lit(1)).alias("__c")).select("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__o", key)) - 1
    return cut.withColumn("__i", inside).join(F.broadcast(starts), "__r").withColumn(name, F.col("__i") + F.col("__s")).drop("__o", "__r", "__i", "__s")


def permutation(frame: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """All rows with their ``place`` from 1 in the order of an epoch."""
    return hash_numbers(frame, hash_order(seed + epoch, key), key, "__n").withColumn("place", F.col("__n") + 1).drop("__n")


def range_numbers(frame: DataFrame, key: str, name: str, ranges: int = 64) -> DataFrame:
    """Number rows from 0 in the order of a numeric key, without a task that holds all rows.

    Quantiles cut the key into ranges; rows are numbered inside a range and
    moved by the sizes before it. Only the quantiles come to the driver.
    """
    return _numbered(_ranges(frame, key, ranges), key, name)


def bucketed_batches(pages: DataFrame, key: str, seed: int, epoch: int, batch: int, pool: int = 32) -> DataFrame:
    """Batches of pages of similar shape: hash order is cut into pools, pools sorted by shape, cut into batches.

    Shape is (rounded 8 w/h, dialogues x candidates, candidates). Batches are
    then put into a hash order of their own. No window holds more than a pool
    or a range of a hash order.
    """
    numbered = hash_numbers(pages, hash_order(seed + epoch, key), key, "__n")
    pooled = numbered.withColumn("__p", F.floor(F.col("__n") / (batch * pool)))
    shape = (F.bround(8 * F.col("width") / F.col("height")), F.col("dialogues") * F.col("candidates"), F.col("candidates"))
    inside = F.floor((F.row_number().over(Window.partitionBy("__p").orderBy(*shape, "__n")) - 1) / batch)
    cut = pooled.withColumn("__b", F.col("__p") * pool + inside)
    batches = hash_numbers(cut.select("__b").distinct(), F.md5(F.concat(F.lit(f"{seed + epoch}|batch|"), F.col("__b").cast("string"))), "__b", "batch")
    return cut.join(batches, "__b").drop("__n", "__p", "__b")


def identity_batches(frame: DataFrame, identity: str, key: str, seed: int, identities: int, rows: int) -> DataFrame:
    """Batches of ``identities`` x ``rows``: members in hash order, repeated from the start if there are too few."""
    # Spark prunes the window to the first ``rows`` members before the shuffle; more are never drawn.
    place = F.row_number().over(Window.partitionBy(identity).orderBy(hash_order(seed, key), key))
    first = frame.select(identity, key, place.alias("__r")).filter(F.col("__r") <= rows)
    members = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(key).alias("k")))), lambda s: s["k"])
    listed = first.groupBy(identity).agg(members.alias("__m"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.get("__m", F.pmod(i, F.size("__m"))))
    numbered = hash_numbers(listed, hash_order(seed + 1, identity), identity, "__n")
    return numbered.select(F.floor(F.col("__n") / identities).alias("batch"), identity, F.explode(drawn).alias(key))


def dense_ids(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, numbered from 0.

    Texts are cut into ranges by their first two characters, numbers by
    quantiles; no task numbers all values.
    """
    values = frame.select(column).filter(F.col(column).isNotNull()).distinct()
    if dict(frame.dtypes)[column] != "string":
        return range_numbers(values, column, "id").select(column, F.col("id").cast("long").alias("id"))
    return _numbered(values.withColumn("__r", F.substring(column, 1, 2)), column, "id").select(column, F.col("id").cast("long").alias("id"))


def _numbered(cut: DataFrame, key: str, name: str, amount: Column | None = None) -> DataFrame:
    """Rows of ascending ranges __r, numbered from 0 by ``key`` over all ranges; with ``amount``, the sum of the amounts before each row.

    Ranges are summed first. Their sums are a row per range, and the sums
    before a range are a window over those rows alone.
    """
    value = F.lit(1) if amount is None else amount
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__r").agg(F.sum(value).alias("__c")).select("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__i", inside).join(starts, "__r").withColumn(name, F.col("__i") + F.col("__s")).drop("__r", "__i", "__s")


def _ranges(frame: DataFrame, key: str, ranges: int) -> DataFrame:
    """Rows with __r, the quantile range of a numeric key; -1 for null."""
    bounds = frame.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    place = F.lit(0)
    for bound in sorted(set(bounds)):
        place = place + (F.col(key) > bound).cast("int")
    return frame.withColumn("__r", F.coalesce(place, F.lit(-1)))


def range_sums(frame: DataFrame, key: str, amount: str, name: str, ranges: int = 64) -> DataFrame:
    """Rows with the sum of ``amount`` over all rows of a smaller key, without a task that holds all rows."""
    return _numbered(_ranges(frame, key, ranges), key, name, F.col(amount))
