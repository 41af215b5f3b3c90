"""Parsers for free-form model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = "ABCDE"
ABSTAIN = ("UNKNOWN", "NONE", "NONE_OF_ABOVE", "UNCERTAIN")


def outer_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the stripped text itself if there are none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.btrim(text))


def parse_object(text: Column) -> Column:
    """The outermost JSON object as a variant, or null."""
    raw = outer_object(text)
    return F.when(F.startswith(raw, F.lit("{")), F.try_parse_json(raw))


def confidence(value: Column, name: str) -> Column:
    """struct(value, error) of a confidence given as text.

    Null, blank, boolean, non-numeric and values outside [0, 1] are errors;
    ``85%`` is 0.85. Nothing is replaced silently.
    """
    text = F.btrim(value.cast("string"))
    share = F.endswith(text, F.lit("%"))
    number = F.btrim(F.when(share, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)).try_cast("double")
    scaled = F.when(share, number / 100).otherwise(number)
    good = (scaled >= 0) & (scaled <= 1) & ~F.isnan(scaled)
    error = (
        F.when(value.isNull(), F.lit(f"{name} is missing"))
        .when(text == "", F.lit(f"{name} is empty"))
        .when(F.lower(text).isin("true", "false"), F.lit(f"{name} must be numeric, not boolean"))
        .when(number.isNull(), F.lit(f"{name} is not numeric"))
        .when(~good, F.lit(f"{name} is outside [0, 1]"))
    )
    return F.struct(F.when(error.isNull(), scaled).alias("value"), error.alias("error"))


def option(text: Column, count: Column) -> Column:
    """struct(index, confidence, error) of an answer that chooses one of the first ``count`` letters.

    Synonyms of unknown give no index and no error. A confidence over 1 and up
    to 100 is a percentage; it is clamped to [0, 1] and 0 if it is no number.
    """
    raw = outer_object(text)
    data = F.from_json(raw, "choice string, confidence string")
    valid = F.try_parse_json(raw).isNotNull() & F.startswith(raw, F.lit("{"))
    letter = F.upper(F.btrim(F.coalesce(data["choice"], F.lit("unknown"))))
    place = F.when(F.length(letter) == 1, F.position(letter, F.substring(F.lit(OPTIONS), F.lit(1), count)))
    given = F.coalesce(data["confidence"].try_cast("double"), F.lit(0.0))
    scaled = F.when((given > 1) & (given <= 100), given / 100).otherwise(given)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    chosen = valid & ~letter.isin(*ABSTAIN) & (F.coalesce(place, F.lit(0)) > 0)
    error = F.when(~valid, F.lit("no valid JSON object")).when(~letter.isin(*ABSTAIN) & (F.coalesce(place, F.lit(0)) == 0), F.concat(F.lit("unsupported choice: "), letter))
    return F.struct(F.when(chosen, place - 1).alias("index"), F.when(chosen, clamped).otherwise(F.lit(0.0)).alias("confidence"), error.alias("error"))
