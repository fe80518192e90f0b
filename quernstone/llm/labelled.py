"""Bounded samples of labelled rows, folds, and calibration for the text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.textarrays import appended


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def smallest(rows: DataFrame, limit: int, seed: int, key: str = "id") -> DataFrame:
    """The ``limit`` rows with the smallest hashes of ``key``.

    A count first gives the hash below which about twice as many rows lie, so that no more than those reach the last
    step, however many tasks there are.
    """
    n = rows.count()
    h = F.xxhash64(F.lit(seed), F.col(key))
    if n > 2 * limit + 200:
        rows = rows.where(h <= F.lit(int(-(2**63) + 2**64 * (2 * limit + 200) / n)))
    return rows.orderBy(h, key).limit(limit)


def sample(labels: DataFrame, label_col: str, held_out: Column, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` (id, label) rows outside the held-out fold, chosen by a hash of the id.

    Null ids and labels are left out; of repeated ids the smallest label stands.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    rows = rows.where(~F.coalesce(held_out, F.lit(False))) if held_out is not None else rows
    return smallest(rows.groupBy("id").agg(F.min("label").alias("label")), limit, 7)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of the sampled rows; of the texts of a repeated id the first in binary order stands.

    ``chosen`` has at most as many rows as the sample's limit, so it is broadcast.
    """
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return few.groupBy("id", "label").agg(F.min("text").alias("text"))


def features(docs: DataFrame, chosen: DataFrame, fn: Callable, fields: list, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """Features of the sampled rows' whole texts, made in the tasks, and their labels; ordered by id."""
    return appended(texts_of(docs, chosen, id_col, text_col), fn, fields, "text").drop("text").toArrow().sort_by("id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities, by Newton steps on Platt's smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    scale = max(float(np.std(z)), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])

    def loss(v):
        m = x @ v
        return float(np.sum(np.logaddexp(0, m) - t * m))

    for _ in range(60):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2)
        step, size, here = np.linalg.solve(h, x.T @ (p - t)), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > here:
            size /= 2
        w = w - size * step
        if np.max(np.abs(step)) < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent on a dense matrix."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    v, vb, t = w.copy(), b, 1.0
    top = np.ones(d, np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the step
        top = x.T @ (x @ top)
        top /= max(float(np.linalg.norm(top)), 1e-12)
    rate = 1.0 / (0.25 * (float(np.linalg.norm(x @ top)) ** 2 / n + 1.0) + l2)
    for _ in range(steps):
        g = (sigmoid(x @ v + vb) - y).astype(np.float32) / n
        nw, nb = v - rate * (x.T @ g + l2 * v), vb - rate * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, float(b)
