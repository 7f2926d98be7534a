"""Quality classifier: supervised subword embeddings with a softmax output.

A word is a run without white space, letter case and punctuation kept. Its vector is the mean of
the learned vectors of its hashed buckets: the word itself and its character n-grams. A document is
the mean over its words, joined by a marker for each word that repeats the one before. Softmax over
two labels, trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
The document mean is linear, so scoring needs one number for each distinct word.

Defined results: a null or empty text scores by the bias alone; a text is scored whole, at any length; repeated
rows are scored row by row; of several labels of an id the smallest counts, of several texts the smallest is learned
from, in whatever order the rows come; labels that are null are not learned from; with no labels at all every score is 0.5; a score at the threshold is accepted; an empty
table gives no rows; other columns are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed_sample, table

#: Labelled rows that are learned from at most, dealt by a hash of doc_id.
TRAIN_ROWS = 2_000
BUCKETS, DIMENSION, EPOCHS, RATE = 1 << 16, 10, 8, 4.0
GRAMS = (3, 4)
THRESHOLD = 0.3
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 120_000
REPEAT = BUCKETS  # the marker has a row of its own


def word_buckets(word: str, grams: tuple[int, ...] = GRAMS) -> list[int]:
    framed = f"<{word}>"
    parts = [framed, *(framed[i : i + n] for n in grams for i in range(len(framed) - n + 1))]
    return [crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass(frozen=True)
class Model:
    """``effect[bucket]``: what the bucket's vector adds to the logit of label 1 over label 0."""

    effect: np.ndarray
    bias: float


def _weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    ids, weights = [], []
    again = repeats(words)
    share = 1.0 / max(1, len(words) + again)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        b = word_buckets(w)
        ids += b
        weights += [share * n / len(b)] * len(b)
    if again:
        ids.append(REPEAT)
        weights.append(share * again)
    distinct, place = np.unique(np.array(ids, np.int64), return_inverse=True)
    return distinct.astype(np.int32), np.bincount(place, weights=weights, minlength=len(distinct)).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    if not texts:
        return Model(np.zeros(BUCKETS + 1), 0.0)
    rows = [_weights(t) for t in texts]
    y = np.array(labels, np.int64)
    embedding = rng.normal(0, 0.5 / DIMENSION, (BUCKETS + 1, DIMENSION))
    out = rng.normal(0, 0.5, (2, DIMENSION))
    prior = np.log((np.bincount(y, minlength=2) + 1) / (len(y) + 2))
    bias = prior.copy()
    total, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - step / total)
            step += 1
            ids, w = rows[i]
            hidden = w @ embedding[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = p @ out
            out -= rate * 0.1 * np.outer(p, hidden)
            bias -= rate * 0.01 * p
            embedding[ids] -= rate * np.outer(w, back)
    return Model(embedding @ (out[1] - out[0]), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.effect, self.bias = model.effect.tolist(), model.bias
        self.words: dict[str, float] = {}
        self.grams: dict[str, float] = {}

    def _word(self, word: str) -> float:
        framed, grams, total = f"<{word}>", self.grams, 0.0
        parts = [framed[i : i + n] for n in GRAMS for i in range(len(framed) - n + 1)]
        for p in parts:
            e = grams.get(p)
            if e is None:
                e = grams[p] = self.effect[crc32(p.encode("utf-8", "replace")) % BUCKETS]
            total += e
        total += self.effect[crc32(framed.encode("utf-8", "replace")) % BUCKETS]
        return total / (len(parts) + 1)

    def score(self, text: str) -> float:
        words = text.split()
        distinct = set(words)
        missing = distinct.difference(self.words)
        if len(self.words) + len(missing) > REMEMBERED:
            self.words.clear()
            missing = distinct
        if len(self.grams) > REMEMBERED:
            self.grams.clear()
        for w in missing:
            self.words[w] = self._word(w)
        again = repeats(words)
        z = self.bias + (sum(map(self.words.__getitem__, words)) + again * self.effect[REPEAT]) / max(1, len(words) + again)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside the held-out fifth; the same ones at any partitioning."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = fixed_sample(known, ["doc_id"], rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``rows`` ids at most
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    return [(r.text, r.quality) for r in sorted(found, key=lambda r: r.doc_id)]


def held_out(doc_id: Column) -> Column:
    """One fifth by the checksum of the id; rows without an id are in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = training_sample(docs, labels, rows)
    return fit([t for t, _ in sample], [q for _, q in sample])


_SCORERS: dict[str, Scorer] = {}


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    key = uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        of = _SCORERS[key].score
        return pd.Series([of(t or "") for t in texts], dtype="float64")

    return score(text)


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    scored = docs.select(F.col("doc_id").cast("long"), score_of(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns of ``docs``."""
    return docs.filter(score_of(docs.sparkSession, model, F.col("text")) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
