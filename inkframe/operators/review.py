"""Review edits as an append-only log; the state is the log folded over the first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNASSIGNED = "unassigned"


def last_edit(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last edit of each key."""
    best = F.max_by(F.struct(*(c for c in log.columns if c != key)), F.col(order))
    return log.groupBy(key).agg(best.alias("e")).select(key, "e.*")


def fold_edits(instances: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """Apply the log(key, order, action, target): ``delete`` demotes, ``move`` sets the cluster, ``restore`` keeps the first one.

    Only the last edit of an instance counts, as each sets all fields it touches.
    """
    final = last_edit(log, key, order).select(key, F.col("action").alias("__a"), F.col("target").alias("__t"))
    joined = instances.join(final, key, "left")
    action = F.coalesce("__a", F.lit("restore"))
    return joined.select(
        *(c for c in instances.columns if c not in ("cluster", "member")),
        F.when(action == "delete", UNASSIGNED).when(action == "move", F.col("__t")).otherwise(F.col("cluster")).alias("cluster"),
        F.when(action == "delete", False).when(action == "move", True).otherwise(F.col("member")).alias("member"),
    )


def next_cluster(instances: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster_NNN`` after the greatest number in use, in one row."""
    number = F.when(F.startswith(F.col(cluster), F.lit("cluster_")), F.element_at(F.split(cluster, "_"), -1).try_cast("int"))
    return instances.agg(F.format_string("cluster_%03d", F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def merge_clusters(instances: DataFrame, mapping: DataFrame, cluster: str = "cluster", name: str = "name") -> DataFrame:
    """Move members of ``source`` clusters to ``target`` and take the target's name (the first by key order)."""
    names = instances.groupBy(cluster).agg(F.min(name).alias("__n")).withColumnRenamed(cluster, "__c")
    joined = instances.join(mapping.select(F.col("source").alias(cluster), "target"), cluster, "left")
    moved = joined.withColumn("__to", F.coalesce("target", cluster)).join(names, F.col("__to") == F.col("__c"), "left")
    kept = [c for c in instances.columns if c not in (cluster, name)]
    return moved.select(*kept, F.col("__to").alias(cluster), F.when(F.col("target").isNotNull(), F.coalesce("__n", F.lit(""))).otherwise(F.col(name)).alias(name))


def rename(frame: DataFrame, names: DataFrame, cluster: str = "cluster", name: str = "name") -> DataFrame:
    """Set names by cluster; a blank name is the cluster's id."""
    given = names.select(F.col("cluster").alias(cluster), F.coalesce(F.nullif(F.btrim("name"), F.lit("")), F.col("cluster")).alias("__n"))
    return frame.join(given, cluster, "left").withColumn(name, F.coalesce("__n", name)).drop("__n")


def rename_candidates(frame: DataFrame, names: dict[str, str], candidates: str) -> DataFrame:
    """The same inside an array of structs with fields cluster and name."""
    table = F.create_map(*(F.lit(x) for pair in ((k, v.strip() or k) for k, v in names.items()) for x in pair))

    def one(c: Column) -> Column:
        return c.withField("name", F.coalesce(table[c["cluster"]], c["name"]))

    return frame.withColumn(candidates, F.transform(candidates, one))


#: Prefixes of names that a reviewer has not given yet.
DEFAULT_NAMES = ("角色簇 ", "character_")


def confirm_problems(instances: DataFrame) -> DataFrame:
    """What forbids to confirm a review: one row (problem, n) each. Columns: cluster, name, member, excluded."""
    retained = ~F.coalesce(F.col("excluded"), F.lit(False))
    reference = retained & F.coalesce(F.col("member"), F.lit(True)) & (F.col("cluster") != UNASSIGNED)
    shown = F.coalesce(F.col("name"), F.lit(""))
    unnamed = (F.btrim(shown) == "") | F.startswith(shown, F.lit(DEFAULT_NAMES[0])) | F.startswith(shown, F.lit(DEFAULT_NAMES[1]))
    counts = instances.agg(
        F.count_if(retained).alias("r"), F.count_if(reference).alias("f"), F.count_distinct(F.when(reference & unnamed, shown)).alias("u")
    )
    problems = F.array(
        F.when(F.col("r") == 0, F.struct(F.lit("nothing retained").alias("problem"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("f") == 0, F.struct(F.lit("no reference").alias("problem"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("u") > 0, F.struct(F.lit("not named").alias("problem"), F.col("u").alias("n"))),
    )
    return counts.select(F.inline(F.filter(problems, lambda p: p.isNotNull())))


def override_speakers(dialogues: DataFrame, log: DataFrame) -> DataFrame:
    """Manual speakers (dialogue_id, seq, cluster, name); the last one wins and is marked as manual."""
    final = last_edit(log, "dialogue_id", "seq").select("dialogue_id", F.col("cluster").alias("__c"), F.col("name").alias("__n"))
    hit = F.col("__c").isNotNull()
    return (
        dialogues.join(final, "dialogue_id", "left")
        .withColumns({"cluster": F.coalesce("__c", "cluster"), "name": F.coalesce("__n", "name"), "source": F.when(hit, "manual").otherwise(F.col("source"))})
        .drop("__c", "__n")
    )


def summary(instances: DataFrame) -> DataFrame:
    """Counts after an edit."""
    return instances.agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("member")).alias("members"), F.count_if(F.col("cluster") == UNASSIGNED).alias("unassigned")
    )


def members_in_order(frame: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of each group numbered in order."""
    return frame.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
