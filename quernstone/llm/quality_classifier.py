"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams each have a learned vector. A document is the average of its
features' vectors (every occurrence counts), a linear layer and a softmax give its classes, and all of it is
trained by stochastic gradient descent in numpy. The output is linear in the average, so for scoring each
bucket's vector is multiplied with the output layer once: a document's logit is the mean of one number a feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.labelled import features, fold, platt, sample, sigmoid
from quernstone.llm.textarrays import Words, appended, characters, gram_ids, released, sums, word_ids

BITS = 16
GRAMS = (3, 4, 5)
SAMPLE_ROWS = 4000
DIM = 10
EPOCHS = 10
RATE = 0.4
SEED = 5


@dataclass
class Model:
    """One number a bucket, and the calibration of the mean."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def families(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature buckets, offset of each row in them) of the kinds of features."""
    words = Words(buf, offs)
    single, pair = word_ids(words, BITS, pairs=True)
    points, first = characters(buf, offs)
    return [(single, words.first), (pair, words.first), *[(g, first) for g in gram_ids(points, first, GRAMS, BITS, lower=False)]]


def bag(buf: np.ndarray, offs: np.ndarray) -> list:
    """The distinct buckets of each row and the share of its features in each."""
    kinds, ids, shares = families(buf, offs), [], []
    for r in range(len(offs) - 1):
        all_ids = np.concatenate([i[f[r] : f[r + 1]] for i, f in kinds])
        u, c = np.unique(all_ids[all_ids < 1 << BITS], return_counts=True)
        ids.append(u.astype(np.uint16).tobytes())
        shares.append((c / max(c.sum(), 1)).astype(np.float16).tobytes())
    return [ids, shares]


BAG = [("ids", T.BinaryType()), ("shares", T.BinaryType())]  # uint16, as BITS is 16, and float16


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out=None, limit: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``limit`` labelled documents outside ``held_out``; every fifth of them only calibrates.

    Labels above 0 count as 1. With no labelled row at all each document scores 0.5.
    """
    rows = features(docs, sample(labels, label_col, held_out, limit), bag, BAG)
    y = (rows["label"].to_numpy() > 0).astype(np.int64)
    if len(y) == 0:
        return Model(np.zeros((1 << BITS) + 1, np.float32), 0.0, 1.0, 0.0)
    ids = [np.frombuffer(v.as_buffer(), np.uint16) for v in rows["ids"]]
    weights = [np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for v in rows["shares"]]
    del rows
    rng = np.random.default_rng(SEED)
    vectors = (rng.random(((1 << BITS), DIM), np.float32) - 0.5) / DIM
    out = (rng.random((DIM, 2), np.float32) - 0.5) / DIM
    bias = np.log(np.bincount(y, minlength=2) + 1.0).astype(np.float32)
    train = np.flatnonzero(np.arange(len(y)) % 5 != 0) if len(y) >= 50 else np.arange(len(y))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            w, at = weights[i], ids[i]
            mean = w @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            # the step of a vector is not divided by the document's length, as its gradient is: relative frequency
            vectors[at] -= rate * np.sqrt(w * w.max() if len(w) else w)[:, None] * (out @ g)[None, :] * 10
            out -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
    number = np.zeros((1 << BITS) + 1, np.float32)
    number[:-1] = vectors @ (out[:, 1] - out[:, 0])
    rest = np.setdiff1d(np.arange(len(y)), train) if len(y) >= 50 else train
    z = np.array([number[ids[i]] @ weights[i] if len(ids[i]) else 0.0 for i in rest])
    slope, shift = platt(z, y[rest])
    del ids, weights, vectors
    released()
    return Model(number, float(bias[1] - bias[0]), slope, shift)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1, from each whole text.

    A null or empty text, or one of white space alone, has no features: its score is that of an average of zero.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(buf, offs):
        m = shared.value
        total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for ids, first in families(buf, offs):
            total += sums(m.weights[ids], first)
            n += sums(ids < 1 << BITS, first)
        return [sigmoid(m.slope * total / np.maximum(n, 1) + m.shift)]

    return appended(docs, run, [("score", T.DoubleType())], text_col)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; see the contract of this operator."""
    model = fit(docs, labels, "quality", fold("doc_id", 5) == 0)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
