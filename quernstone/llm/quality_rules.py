"""Quality rules: fixed base rules and a hashed n-gram logistic regression with calibrated probabilities.

Both run in one pass over whole texts, in Arrow batches. The base rules are exact counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.labelled import features, logistic, platt, sample, sigmoid
from quernstone.llm.textarrays import Words, appended, byte_hashes, characters, gram_ids, mix, runs, sums, word_ids

BITS = 12
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 4000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROWS = 256  # texts whose dense count vectors are held at once

# Fixed values of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float


def dense(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of hashed words, word pairs and character n-grams, a row a text."""
    words = Words(buf, offs)
    single, pair = word_ids(words, BITS, pairs=True)
    points, first = characters(buf, offs)
    width, n = (1 << BITS) + 1, len(offs) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    for ids, at in [(single, words.first), (pair, words.first), *[(g, first) for g in gram_ids(points, first, GRAMS, BITS, lower=False)]]:
        for lo in range(0, n, ROWS):
            hi = min(lo + ROWS, n)
            part = ids[at[lo] : at[hi]] + np.repeat(np.arange(hi - lo) * width, np.diff(at[lo : hi + 1]))
            counts = np.bincount(part, minlength=(hi - lo) * width).reshape(hi - lo, width)[:, :-1]
            out[lo:hi] += counts
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out=None, limit: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``limit`` labelled documents; every fifth of them only calibrates. Unlabelled: all 0.5."""

    def rows_of(buf, offs):
        return [[x.tobytes() for x in dense(buf, offs)]]

    rows = features(docs, sample(labels, label_col, held_out, limit), rows_of, [("x", T.BinaryType())])
    y = (rows["label"].to_numpy() > 0).astype(np.float32)
    if len(y) == 0:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, 0.0)
    x = np.empty((len(y), 1 << BITS), np.float32)
    for i, v in enumerate(rows["x"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    del rows
    apart = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.ones(len(y), bool)
    train = ~apart if len(y) >= 50 else apart
    x *= 16  # rows have unit length spread over thousands of features: brings the weights near one
    w, _ = logistic(x[train], y[train], 1e-4, 200)
    slope, shift = platt((x[apart] @ w).astype(np.float64), y[apart])
    return Model(w * 16, slope, shift)


def base_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    words = Words(buf, offs)
    n = len(offs) - 1
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    chars = sums(lead[words.ends] - lead[words.starts], words.first)
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])
    row = words.rows()

    # lines that hold a word: from the byte after the last \n or row edge before it to the next \n or row end
    dup = np.zeros(n, np.int64)
    if len(words):
        breaks = np.flatnonzero(buf == 10)
        line = np.searchsorted(breaks, words.starts)
        new = np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])]
        line, owner = line[new], row[new]
        begins = np.maximum(np.where(line > 0, breaks[line - 1] + 1, 0) if len(breaks) else 0, offs[owner])
        ends = np.minimum(np.append(breaks, len(buf))[line], offs[owner + 1])
        key = mix(byte_hashes(buf, begins, ends) + mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order[1:]] == key[order[:-1]]]
        dup = np.bincount(owner[again], minlength=n)

    # words in 3-word windows found at least twice in their row
    repeat = np.zeros(n, np.int64)
    if len(words) > 2:
        h = words.hashes()
        at = np.flatnonzero(row[:-2] == row[2:])
        if len(at):
            key = mix(runs(h, 3)[at] + mix(row[at].astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            k = key[order]
            twice = np.zeros(len(k), bool)
            twice[1:] |= k[1:] == k[:-1]
            twice[:-1] |= k[1:] == k[:-1]
            hit = at[order[twice]]
            covered = np.zeros(len(h), bool)
            for j in range(3):
                covered[hit + j] = True
            repeat = sums(covered, words.first).astype(np.int64)
    return words.counts(), chars.astype(np.int64), symbols[offs[1:]] - symbols[offs[:-1]], dup, repeat


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, the probability ``score`` and ``kept``.

    A null or empty text has no words: it fails the base rules. Rows are judged one by one, repeated ones alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(buf, offs):
        m = shared.value
        n_words, chars, symbols, dup, repeat = base_counts(buf, offs)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        p = sigmoid(m.slope * (dense(buf, offs) @ m.weights).astype(np.float64) + m.shift)
        return [n_words, chars, symbols, dup, repeat, failed, p, ~failed & (p >= KEEP_AT)]

    long, flag = T.LongType(), T.BooleanType()
    return appended(docs, run, [("n_words", long), ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long), ("base_failed", flag), ("score", T.DoubleType()), ("kept", flag)], text_col)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts and verdict of every document; see the contract of this operator."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("score"))
