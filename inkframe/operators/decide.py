"""Decision tables over model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators.checks import passes

NON_CHARACTER = ("narration", "sound_effect")


def panel_decision(threshold: float = 0.80) -> Column:
    """Status of a dialogue after the panel pass, in this order:

    no response: fallback; confirmed narration or sound effect:
    filtered_non_dialogue; no confirmed character link: fallback; confirmed
    offscreen speaker: offscreen; invalid or weak choice or no evidence:
    fallback; else accepted. Columns: has_response, type, type_confidence,
    requires_link, link_confidence, choice, speaker_confidence, has_evidence,
    choice_valid.
    """
    c = F.col
    linked = F.coalesce(c("requires_link"), F.lit(False))
    sure_type, sure_link = passes(c("type_confidence"), threshold), passes(c("link_confidence"), threshold)
    evidence = F.coalesce(c("has_evidence"), F.lit(False))
    sure_speaker = passes(c("speaker_confidence"), threshold)
    return (
        F.when(~c("has_response"), "fallback")
        .when(c("type").isin(*NON_CHARACTER) & ~linked & sure_type & sure_link, "filtered_non_dialogue")
        .when(~linked | ~sure_link | ~sure_type, "fallback")
        .when((F.upper(c("choice")) == "OFFSCREEN") & sure_speaker & evidence, "offscreen")
        .when(~F.coalesce(c("choice_valid"), F.lit(False)) | ~sure_speaker | ~evidence, "fallback")
        .otherwise("accepted")
    )


def identity_decision(threshold: float = 0.70) -> Column:
    """fallback without a valid, confident choice; else accepted. Columns: has_response, choice_valid, confidence."""
    good = F.col("has_response") & F.coalesce(F.col("choice_valid"), F.lit(False)) & passes(F.col("confidence"), threshold)
    return F.when(good, "accepted").otherwise("fallback")


def strict_decision(threshold: float = 0.70) -> Column:
    """The older table: what is not accepted is unknown."""
    return F.when(identity_decision(threshold) == "accepted", "accepted").otherwise("unknown")


def apply_choice(frame: DataFrame, accepted: Column, unknown: Column, columns: dict[str, Column]) -> DataFrame:
    """Overwrite columns of accepted rows and blank them in unknown ones; the first value is kept as ``<column>_before``."""
    out = frame
    for name, value in columns.items():
        before = f"{name}_before"
        first = F.coalesce(F.col(before), F.col(name)) if before in frame.columns else F.col(name)
        out = out.withColumn(before, F.when(accepted | unknown, first).otherwise(F.col(before) if before in frame.columns else F.lit(None)))
        out = out.withColumn(name, F.when(accepted, value).when(unknown, F.lit(None)).otherwise(F.col(name)))
    return out


def limited_review(dialogues: DataFrame, page: str, limit: int, status: str = "status") -> DataFrame:
    """Rows beyond the first ``limit`` pages (in page order) are not reviewed."""
    reviewed = F.dense_rank().over(Window.orderBy(page)) <= limit
    pages = dialogues.select(page).distinct().withColumn("__in", reviewed)
    return dialogues.join(pages, page).withColumn(status, F.when(F.col("__in"), F.col(status)).otherwise("not_reviewed")).drop("__in")


def audit_category() -> Column:
    """not_dialogue, unknown, correct or wrong, from is_dialogue, predicted and truth."""
    return (
        F.when(~F.coalesce(F.col("is_dialogue"), F.lit(False)), "not_dialogue")
        .when(F.col("predicted").isNull(), "unknown")
        .when(F.col("predicted") == F.col("truth"), "correct")
        .otherwise("wrong")
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Rates with denominators of 1 at least. Columns: is_dialogue, is_exact, similarity, accepted, predicted, truth, in_top5."""
    dialogue, accepted = F.col("is_dialogue"), F.col("accepted")
    right = F.col("predicted").eqNullSafe(F.col("truth")) & F.col("truth").isNotNull()
    linked = dialogue & F.col("truth").isNotNull()
    rate = lambda top, bottom: F.count_if(top) / F.greatest(F.count_if(bottom), F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(dialogue).alias("dialogues"),
        rate(F.col("is_exact"), F.lit(True)).alias("exact_rate"),
        (F.coalesce(F.sum("similarity"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_similarity"),
        rate(linked & right, linked).alias("top1_recall"),
        rate(linked & F.col("in_top5"), linked).alias("top5_recall"),
        rate(accepted & linked & right, accepted & linked).alias("accepted_precision"),
        rate(linked & F.col("predicted").isNull(), linked).alias("unknown_rate"),
    )
