"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram in the whole text. Its value is the log ratio of its
smoothed frequencies in toxic and other documents; logistic regression learns a weight for each value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.labelled import fold, logistic, platt, sample, sigmoid, texts_of
from quernstone.llm.textarrays import appended, blocks, characters, gram_ids, released
from quernstone.session import written

BITS = 20
GRAMS = (4, 5, 6)
SAMPLE_ROWS = 4000  # a third of them toxic at most
KEPT = 4096  # n-grams that get a weight: those whose counts differ most between the classes (chi-squared)
STEPS = 300
DECIDE = 0.7  # the score from which a document is to be held for toxic
NEAR_BEST = 0.98


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float


def present(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The distinct buckets of each row, in no order."""
    points, first = characters(buf, offs)
    kinds = gram_ids(points, first, GRAMS, BITS, lower=True)
    last = np.empty((1 << BITS) + 1, np.int32)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        ids = np.concatenate([k[a:b] for k in kinds])
        place = np.arange(len(ids), dtype=np.int32)
        last[ids] = place  # of equal buckets one place stays
        out.append(ids[(last[ids] == place) & (ids < 1 << BITS)])
    return out


def class_counts(rows: DataFrame) -> list[np.ndarray]:
    """In how many texts of ``rows`` (label, text) each bucket occurs, for labels 0 and 1; counted in the tasks."""

    def run(batches):
        df = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for lo, _, buf, offs in blocks(batch.column(1)):
                for r, ids in enumerate(present(buf, offs)):
                    df[int(label[lo + r] > 0)][ids] += 1
        at = np.flatnonzero(df.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[0][at]), pa.array(df[1][at])], names=["bucket", "n0", "n1"])

    both = rows.select("label", "text").mapInArrow(run, "bucket int, n0 int, n1 int").groupBy("bucket")
    got = both.agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")).toArrow()  # at most 2**BITS rows
    out = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for k in (0, 1):
        out[k][got["bucket"].to_numpy()] = got[f"n{k}"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out=None, limit: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``limit`` labelled documents outside ``held_out``; every fifth of them only calibrates.

    Toxic documents are rare, so they are sampled apart, a third of the limit. Scores are probabilities at that mix,
    their log-odds then raised so that the cut that serves the calibrating rows best lies at DECIDE (:func:`best_cut`).
    Below 50 labelled rows all of them both train and calibrate. Labels above 0 count as 1; of the labels of a repeated
    id the smallest stands. With no labelled row at all each document scores 0.5.
    """
    labels = labels.select("doc_id", F.col(label_col).alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    toxic = F.col("label") > 0
    chosen = sample(labels.where(toxic), "label", held_out, limit // 3).union(sample(labels.where(~toxic), "label", held_out, limit - limit // 3))
    rows = written(texts_of(docs, chosen).withColumn("apart", F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(5)) == 0), "sample")
    n = {(bool(r.apart), int(r.y)): r.n for r in rows.groupBy("apart", (F.col("label") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if not total:
        return Model(weights, 1.0, 0.0)
    if total < 50:  # too few to set some apart
        rows = rows.withColumn("apart", F.lit(False))
        n = {(False, k): n.get((False, k), 0) + n.get((True, k), 0) for k in (0, 1)}
    df = class_counts(rows.where("not apart"))
    of = [float(n.get((False, k), 0)) for k in (0, 1)]
    ratio = np.log((df[1] + 1) / (of[1] + 2)) - np.log((df[0] + 1) / (of[0] + 2))
    share = (df[0] + df[1]) / max(sum(of), 1)
    expected = share * of[1]
    apartness = (df[1] - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    kept = np.sort(np.argsort(-apartness, kind="stable")[:KEPT])
    del df, share, expected, apartness
    column = np.full((1 << BITS) + 1, -1, np.int32)
    column[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def bits(buf, offs):
        out = np.zeros((len(offs) - 1, KEPT), bool)
        for r, ids in enumerate(present(buf, offs)):
            at = shared.value[ids]
            out[r, at[at >= 0]] = True
        return [[row.tobytes() for row in np.packbits(out, axis=1)]]

    got = appended(rows, bits, [("bits", T.BinaryType())], "text").drop("text").toArrow().sort_by("id")
    shared.destroy()
    y = (got["label"].to_numpy() > 0).astype(np.float32)
    apart = got["apart"].to_numpy()
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(len(y), -1), axis=1)[:, :KEPT].astype(np.float32)
    x *= ratio[kept].astype(np.float32)
    w, _ = logistic(x[~apart], y[~apart], 1e-4, STEPS)
    rest = apart if apart.any() else ~apart
    margin = (x[rest] @ w).astype(np.float64)
    slope, shift = platt(margin, y[rest])
    table = labels.where(~F.coalesce(held_out, F.lit(False))) if held_out is not None else labels
    every = {bool(r.t): r.n for r in table.groupBy(toxic.alias("t")).agg(F.count("*").alias("n")).collect()}
    others = every.get(False, 0) * float(y[rest].sum()) / max(every.get(True, 0) * float((1 - y[rest]).sum()), 1e-9)
    shift += max(0.0, float(np.log(DECIDE / (1 - DECIDE))) - best_cut(slope * margin + shift, y[rest], others))
    weights[kept] = w * ratio[kept]
    del x
    released()
    return Model(weights, slope, shift)


def best_cut(odds: np.ndarray, y: np.ndarray, others: float) -> float:
    """The middle of the log-odds from which taking rows for toxic has nearly the best F-measure; infinite if a class is
    missing.

    ``others`` is what a row of class 0 counts, so that the classes have the whole table's mix.
    """
    if not y.any() or y.all():
        return np.inf
    order = np.argsort(-odds, kind="stable")
    value, hit = odds[order], y[order] > 0
    tp, fp = np.cumsum(hit), np.cumsum(~hit) * others
    f = 2 * tp / (tp + fp + hit.sum())
    f[:-1][value[:-1] == value[1:]] = 0  # equal rows are taken together
    good = np.flatnonzero(f >= NEAR_BEST * f.max())
    return float(value[good[0]] + value[good[-1]]) / 2


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, higher where label 1 is likelier, from each whole text; see :func:`fit`.

    A null or empty text has no n-grams and gets the score of the intercept alone. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(buf, offs):
        m = shared.value
        z = np.array([m.weights[ids].sum(dtype=np.float64) for ids in present(buf, offs)])
        return [sigmoid(m.slope * z + m.shift)]

    return appended(docs, run, [("score", T.DoubleType())], text_col)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; see the contract of this operator."""
    model = fit(docs, labels, "toxic", fold("doc_id", 3) == 1)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
