"""The pipeline's stages against the operators and brute force."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkframe.llm import bpe, minhash, mixing, quality
from tests.llm.test_ops import AWKWARD, by_id, cut, near_groups, texts_of


@pytest.fixture
def awkward_texts(spark):
    return spark.createDataFrame([(i, "en", "s", t) for i, t in AWKWARD], "doc_id long, lang string, source string, text string")


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        outputs.append(docs)
    assert all(f.columns == columns for f in outputs[:-1])
    raw = spark.read.parquet(f"{small}/documents.parquet")
    texts = [texts_of(raw), *(texts_of(f) for f in outputs[:-1])]

    assert set(texts[1]) == {i for i, r in by_id(quality.assess(raw)).items() if r["kept"]}
    groups = near_groups(texts[1])
    assert texts[2] == {i: t for i, t in texts[1].items() if groups[i][1] == i}
    want = cut(texts[2])
    assert set(texts[3]) == {i for i, (n, gone, _) in want.items() if n > gone or gone == 0}
    for i, t in texts[3].items():
        assert t == texts[2][i] if want[i][1] == 0 else hashlib.sha256(t.encode()).hexdigest() == want[i][2]
    assert set(texts[4]) == {i for i, r in by_id(mixing.assign(outputs[2])).items() if r["sampled"]}
    made = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in outputs[4].collect()} == {i: made.encode(t) for i, t in texts[4].items()}
    assert minhash.Settings().percent == 75


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "encode_tokens"]


def test_stages_on_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.encode_tokens(spark, docs, small).count() == 0


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, repeated rows and ids, and columns with names that the stages use."""
    text = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " x", None, None, None), (None, text, "en", "a", 1), (None, None, None, None, None), (3, "", "en", "a", 0), (1, other, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(5) for c in ("tie", "rep", "k1", "host", "kept", "n_removed", "kept_text", "topic", "ids_x")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    assert kept["quality_rules"] == sorted([(i, t) for i, t, *_ in rows if t and len(t) > 9], key=str)
    assert kept["near_dedup"] == sorted([(1, text), (1, other), (None, text), (None, None), (3, "")], key=str)
    assert kept["substring_dedup"] == sorted([(1, text), (1, text), (2, "x"), (None, text), (None, None), (3, ""), (1, other)], key=str)
    assert corpus_pipeline.encode_tokens(spark, docs, "").count() == len(rows)


def test_last_stage_decodes(spark, awkward_texts):
    got = by_id(corpus_pipeline.encode_tokens(spark, awkward_texts, ""))
    want = by_id(bpe.digest_documents(awkward_texts, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    for i, text in texts_of(awkward_texts).items():
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i]["ids_sha256"] == want[i]["ids_sha256"] and len(got[i]["ids"]) == got[i]["n_tokens"]


def test_stages_with_the_names_that_operators_make(spark):
    """Names with two underscores, quotes and spaces pass every stage with their values."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, " ".join(f"other{i}" for i in range(80)), None, "b", 1)]
    names = ("__frequent", "__k1", "__k2", "__free", "__n_removed", "__kept_text", "__tokens", "__topic", "__host", "__s", "__draw", "__sampled", "passed0", "passed6", "a b", "size")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*(F.lit(f"{n} kept").alias(n) for n in names[:8]), "*", *(F.lit(f"{n} kept").alias(n) for n in names[8:]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        got = found.collect()
        assert got and all(r[n] == f"{n} kept" for r in got for n in names)
