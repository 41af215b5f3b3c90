"""Text normalisers, similarity, labels and ids as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkframe.functions import blocks


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no built-in for it."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def strip_space(text: Column) -> Column:
    """Without any Unicode white space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def normalize(text: Column) -> Column:
    """NFKC, then without white space; null and empty give the empty text."""
    return strip_space(nfkc(F.coalesce(text, F.lit(""))))


def core_text(text: Column) -> Column:
    """``normalize``, then without punctuation and symbols; kana marks are letters and stay."""
    return F.regexp_replace(normalize(text), r"[\p{P}\p{S}]", "")


def clean_label(text: Column) -> Column:
    """CR and LF deleted, TAB made a space, nothing else."""
    return F.replace(F.translate(text, "\r\n", ""), F.lit("\t"), F.lit(" "))


def matching_ratio(a: str, b: str) -> float:
    """2 x matched characters / all characters by recursive longest blocks; the order of a and b matters."""
    return float(blocks.ratios([a], [b])[0])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``matching_ratio`` of two columns; null counts as empty, two empty texts are equal."""
    return pd.Series(blocks.ratios(a.fillna("").to_list(), b.fillna("").to_list()), dtype="float64")


def guarded_similarity(a: Column, b: Column) -> Column:
    """Similarity without white space: 1 for two empty texts, 0 for one."""
    x, y = strip_space(a), strip_space(b)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(similarity(x, y))


def either_contains(a: Column, b: Column) -> Column:
    """Whether one non-empty text is part of the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def best_concat(target: str, pieces: list[str]) -> tuple[str, float]:
    """The order of the non-empty pieces whose concatenation is most similar to the target, the first at ties."""
    texts, scores = blocks.best_orders([target], [pieces])
    return texts[0], float(scores[0])


@F.pandas_udf(StructType([StructField("joined", StringType()), StructField("score", DoubleType())]))
def best_concat_match(target: pd.Series, pieces: pd.Series) -> pd.DataFrame:
    """``best_concat`` of core texts."""
    texts, scores = blocks.best_orders(target.fillna("").to_list(), [[] if p is None else list(p) for p in pieces])
    return pd.DataFrame({"joined": texts, "score": scores})


@F.pandas_udf(StringType())
def character_name(ch: pd.Series) -> pd.Series:
    """Unicode name or UNKNOWN."""
    return ch.map(lambda c: unicodedata.name(c, "UNKNOWN") if c else "UNKNOWN")


def code_point(ch: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def file_safe(value: Column, trim: str = "._", default: str = "item") -> Column:
    """Runs of other characters than A-Z a-z 0-9 . _ - become ``_``; trimmed; a default if nothing is left."""
    out = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9A-Za-z._-]+", "_"), F.lit(trim))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def cache_filename(key: Column, suffix: str) -> Column:
    """A page key as a file name."""
    return F.concat(F.replace(F.replace(key, F.lit("/"), F.lit("__")), F.lit("'"), F.lit("_")), F.lit(suffix))


def image_path(book: Column, page: Column) -> Column:
    return F.format_string("images/%s/%03d.jpg", book, page)


def identity_id(book: Column, character: Column) -> Column:
    return F.concat(book.cast("string"), F.lit("::"), character.cast("string"))


def record_key(book: Column, page: Column, annotation: Column) -> Column:
    return F.format_string("%s/%03d/%s", book.cast("string"), page, annotation.cast("string"))


def component_id(book: Column, page: Column, number: Column) -> Column:
    return F.format_string("%s:p%03d:component%03d", book.cast("string"), page, number)


def instance_id(page: Column, number: Column) -> Column:
    return F.format_string("P%03d_C%03d", page, number)


def dialogue_id(page: Column, number: Column) -> Column:
    return F.format_string("P%03d_T%03d", page, number)


def is_other(name: Column) -> Column:
    """Whether a character name is the catch-all ``other``."""
    return F.coalesce(F.lower(F.btrim(name)) == "other", F.lit(False))


def percent(value: Column) -> Column:
    """``75.23%``, or ``?`` for null."""
    return F.when(value.isNull(), "?").otherwise(F.format_string("%.2f%%", value * 100))


def signed_points(value: Column) -> Column:
    """``+1.23 pp``, or ``?`` for null."""
    return F.when(value.isNull(), "?").otherwise(F.format_string("%+.2f pp", value * 100))


def characters(text: Column) -> Column:
    """Characters of a text, one array entry per code point; none for null or empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def label_flags(text: Column) -> Column:
    """What is odd about a raw label."""
    cleaned = clean_label(text)
    return F.struct(
        (F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))).alias("has_newline"),
        F.contains(text, F.lit("\t")).alias("has_tab"),
        (F.btrim(cleaned) == "").alias("is_empty"),
        F.char_length(cleaned).alias("length"),
    )


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding for output."""
    return F.bround(value, digits)
