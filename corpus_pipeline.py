"""A training-data pipeline in stages; each takes and returns a table of documents.

quality rules -> near-dedup -> substring dedup -> mixture -> token ids. Every
stage works on all that its predecessor kept. The last returns a row per
document: doc_id, lang, source, n_tokens, ids and the digests of op3.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import bpe, minhash, mixing, quality, substring
from inkframe.llm.columns import passing
from inkframe.llm.store import Store
from inkframe.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject, and frequent lines of the others."""
    prepare(spark)
    return quality.clean(docs, "source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of least doc_id, of each group of near-duplicates."""
    prepare(spark)
    return minhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts spans that start in an earlier document, and drops documents of which nothing is left."""
    prepare(spark)
    return passing(docs, ("doc_id", "text", "n_chars"), _without_duplicates)


def _without_duplicates(docs: DataFrame) -> DataFrame:
    found = substring.duplicate_spans(docs, keep=tuple(docs.columns), prefix="__")
    left = found.filter("__n_removed = 0 OR __kept_text <> ''")
    text = F.when(F.col("__n_removed") == 0, F.col("text")).otherwise(F.col("__kept_text"))
    columns = {"text": text, "n_chars": F.when(F.col("__n_removed") == 0, F.col("n_chars")).otherwise(F.char_length(text)).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return left.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that token weights meet the marginals."""
    prepare(spark)
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's whole text, and digests of them and of what they decode to."""
    prepare(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_and_digest(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]
#: Sketches, rakes and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
