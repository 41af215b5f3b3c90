"""Language identification: logistic regression on TF-IDF character n-grams.

The classifier is multinomial, trained by follow-the-regularised-leader with
elastic-net penalties, and calibrated by a temperature.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm import words as W

U = np.uint64
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Features, training and the bound on training rows.

    Document frequencies come from every training document. The classifier is
    fitted on at most ``sample`` of them, drawn by a hash of their doc_id; a
    fifth of the sample is kept for the temperature.
    """

    orders: int = 3
    buckets: int = 1 << 15
    sample: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 8.0
    seed: int = 17


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the text of each, and which texts have a letter.

    Runs of other characters count as one space. n-grams of one order are
    together, in text order.
    """
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    n = len(offsets) - 1
    heads = np.append(0, np.cumsum((part & 0xC0) != 0x80))
    code = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(n), np.diff(heads[offsets - base]))
    letter = _letters()[code]
    fresh = np.append(True, (letter[:-1] != 0) | (text[1:] != text[:-1])) if len(letter) else np.zeros(0, bool)
    keep = (letter != 0) | fresh
    letter, text = letter[keep].astype(U), text[keep]
    has = np.zeros(n, bool)
    has[text[letter != 0]] = True
    found, owners = [], []
    for order in range(1, s.orders + 1):
        m = len(letter) - order + 1
        if m <= 0:
            break
        h = np.full(m, order, U)
        for j in range(order):
            h = (h ^ letter[j : m + j]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        at = np.flatnonzero(text[:m] == text[order - 1 :])
        found.append((h[at] % U(s.buckets)).astype(np.int32))
        owners.append(text[at])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(owners), has


def _sparse(bucket: np.ndarray, owner: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct buckets of each text."""
    key, n = np.unique(owner.astype(np.int64) * s.buckets + bucket, return_counts=True)
    return key // s.buckets, (key % s.buckets).astype(np.int32), n


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_frequencies(texts: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each bucket occurs, and their number.

    A task sends one row of fixed width for all of its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(s.buckets, np.int64), 0
        seen = np.zeros(s.buckets, bool)
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets, W.PIECE):
                bucket, owner, _ = grams(data, offsets[low : high + 1], s)
                order = np.argsort(owner, kind="stable")
                bucket = bucket[order]
                ends = np.cumsum(np.bincount(owner, minlength=high - low))
                at = 0
                for end in ends.tolist():
                    seen[bucket[at:end]] = True
                    total += seen
                    seen[bucket[at:end]] = False
                    at = end
                n += high - low
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["df", "n"])

    parts = texts.select("text").mapInArrow(run, "df array<long>, n long")
    every = parts.select("n", F.posexplode("df").alias("bucket", "df")).groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    out, n = np.zeros(s.buckets, np.int64), 0
    for row in every.collect():
        out[row["bucket"]], n = row["df"], row["n"]
    return out, n


def sample_features(texts: DataFrame, n: int, s: Settings) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """Buckets, counts and label of at most ``s.sample`` of the n texts."""
    if not n:
        return [], [], []
    # By id and text, so that rows which repeat an id are drawn apart; the order makes the bound hold for equal rows, too.
    hashed = texts.withColumn("h", F.xxhash64(F.lit(s.seed), F.col("doc_id"), F.col("text")))
    draw = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    chosen = hashed.filter(draw < min(1.0, s.sample / n)).select("h", "doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets, W.PIECE):
                bucket, owner, _ = grams(data, offsets[low : high + 1], s)
                text, bucket, count = _sparse(bucket, owner, s)
                ends = np.append(0, np.cumsum(np.bincount(text, minlength=high - low))).tolist()
                pairs = [(bucket[a:b].tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, high - low) for c in ("h", "doc_id", "lang")),
                        pa.array([p[0] for p in pairs], pa.binary()),
                        pa.array([p[1] for p in pairs], pa.binary()),
                    ],
                    names=["h", "doc_id", "lang", "bucket", "count"],
                )

    rows = chosen.mapInArrow(run, "h long, doc_id string, lang string, bucket binary, count binary").orderBy("h", "doc_id", "lang").limit(s.sample).toArrow()
    unpack = lambda name: [np.frombuffer(x, np.int32) for x in rows.column(name).to_pylist()]
    return unpack("bucket"), unpack("count"), rows.column("lang").to_pylist()


@dataclass(frozen=True)
class Model:
    """Languages in ascending order, idf x weights of each bucket, bias and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of each text, and which texts have a letter."""
        n = len(offsets) - 1
        bucket, owner, has = grams(data, offsets, self.settings)
        size = np.maximum(np.bincount(owner, minlength=n), 1)
        out = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            total = np.bincount(owner, weights=self.weights[:, k][bucket], minlength=n)
            out[:, k] = total * self.settings.scale / size + self.bias[k]
        return out / self.temperature, has


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 penalties."""

    def __init__(self, buckets: int, classes: int, s: Settings):
        self.z = np.zeros((buckets + 1, classes))
        self.n = np.zeros((buckets + 1, classes))
        self.s = s

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] = grown


def train(buckets: list[np.ndarray], counts: list[np.ndarray], labels: list[str], df: np.ndarray, n: int, s: Settings) -> Model:
    """Fit and calibrate; without any example the model knows no language."""
    languages = sorted(set(labels))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    if not languages:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, s)
    number = {name: i for i, name in enumerate(languages)}
    usable = [i for i, b in enumerate(buckets) if len(b)]
    examples = []
    for i in usable:
        x = counts[i] / counts[i].sum() * idf[buckets[i]] * s.scale
        examples.append((np.append(buckets[i], s.buckets), np.append(x, 1.0), number[labels[i]]))
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(examples))
    held = order[: len(examples) // 5]
    fit = order[len(examples) // 5 :]
    leader = Ftrl(s.buckets, len(languages), s)
    for _ in range(s.epochs):
        for i in rng.permutation(fit).tolist():
            leader.step(*examples[i])
    w = leader.weights(slice(None))
    temperature = 1.0
    if len(held):
        raw = np.stack([examples[i][1] @ w[examples[i][0]] for i in held.tolist()])
        truth = np.array([examples[i][2] for i in held.tolist()])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 241))
        loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature, s)


def learn(documents: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from text and lang of the documents that are not held out; rows without text or lang teach nothing."""
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    teaching = rows.filter(~is_held_out(F.col("doc_id"))).filter("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(teaching, s)
    return train(*sample_features(teaching, n, s), df, n, s)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score; only the text decides the prediction.

    A null text, a text without a letter, and every text if no language was
    learned, is ``und`` with score 0. Equal probabilities go to the language
    first in the alphabet. Repeated rows are predicted alike; an empty table
    gives an empty result. Columns other than doc_id and text are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for low, high in W.slices(offsets, W.PIECE):
                n = high - low
                if made.languages:
                    logits, has = made.logits(data, offsets[low : high + 1])
                    p = softmax(logits)
                    best = p.argmax(axis=1)
                    score = np.where(has, p[np.arange(n), best], 0.0)
                    name = [made.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                else:
                    score, name = np.zeros(n), [UNDETERMINED] * n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, n), batch.column("held_out").slice(low, n), pa.array(name, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
