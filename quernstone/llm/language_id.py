"""Language identification by the nearest centroid.

A text is its L2-normalised TF-IDF vector of hashed character n-grams. Each language has several centroids, found
by spherical k-means on a bounded sample; document frequencies come from all documents that may be learned from.
A text gets the language of the centroid with the largest cosine. It is marked rejected if even that one is out of the
language's reach: the distance that best parts the language's own texts from texts of other languages that come nearest
to it, found on sampled texts which no centroid has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.labelled import fold, texts_of
from quernstone.llm.textarrays import appended, blocks, characters, gram_ids
from quernstone.session import written

BITS = 12
GRAMS = (1, 2, 3)
SAMPLE_ROWS = 800  # of each language
CENTROIDS = 3  # of each language
ROUNDS = 12
FARTHEST = 0.95  # no reach is larger: a text that shares hardly an n-gram with a language is not in it
ROWS = 256
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray


def letters_only(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with all that is no letter as a space, and which are letters."""
    letter = _LETTER[np.minimum(points, 0x24F)]
    high = points >= 0x250
    if high.any():
        seen, back = np.unique(points[high], return_inverse=True)
        letter = letter.copy()
        letter[high] = np.array([chr(c).isalpha() for c in seen])[back]
    return np.where(letter, points, 32).astype(np.uint32), letter


def counts(points: np.ndarray, first: np.ndarray):
    """(first row, end row, dense n-gram counts) of runs of rows."""
    width, n = (1 << BITS) + 1, len(first) - 1
    kinds = gram_ids(points, first, GRAMS, BITS, lower=True)
    for lo in range(0, n, ROWS):
        hi = min(lo + ROWS, n)
        base = np.repeat(np.arange(hi - lo) * width, np.diff(first[lo : hi + 1]))
        total = np.zeros((hi - lo) * width, np.float32)
        for ids in kinds:
            total += np.bincount(ids[first[lo] : first[hi]] + base, minlength=len(total))
        yield lo, hi, total.reshape(hi - lo, width)[:, :-1]


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; at most one row a bucket leaves a task."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(0)):
                n += hi - lo
                points, first = characters(buf, offs)
                for _, _, tf in counts(letters_only(points)[0], first):
                    df += (tf > 0).sum(0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "df"])

    rows = docs.select(text_col).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    out, n = np.zeros(1 << BITS, np.float64), 0
    for r in rows:
        if r.bucket < 0:
            n = r.df
        else:
            out[r.bucket] = r.df
    return out, n


def fit(docs: DataFrame, held_out=None, limit: int = SAMPLE_ROWS) -> Model:
    """Learn from text and non-null lang of the documents outside ``held_out``.

    Centroids come from at most ``limit`` documents a language, taken by a hash of the id; every fifth of them only
    serves to find the reach (of a language without such a one, all of them serve for both). Of the texts and languages
    of a repeated id the first in order stand. Texts are taken whole, whatever their length. With no document to learn
    from there are no languages, and every text is undetermined.
    """
    allowed = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        allowed = allowed.where(~held_out)
    df, n = document_frequencies(allowed)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    # a hash below a bound that each language's count gives leaves about twice the limit to rank
    h = F.xxhash64(F.lit(3), "doc_id")
    # a row a language is less than the model, which has centroids for each; unless broadcast, lang would be shuffled
    per = F.broadcast(allowed.groupBy("lang").agg(F.count("*").alias("__c")))
    below = F.lit(-(2.0**63)) + F.lit(2.0**64) * (2 * limit + 200) / F.col("__c")
    chosen = allowed.select("doc_id", "lang").join(per, "lang").where(h.cast("double") <= below)
    by = Window.partitionBy("lang").orderBy(h, "doc_id")
    chosen = chosen.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit)
    chosen = chosen.groupBy(F.col("doc_id").alias("id")).agg(F.min("lang").alias("label"))

    def rows_of(buf, offs):
        points, first = characters(buf, offs)
        return [[r.astype(np.float32).tobytes() for _, _, tf in counts(letters_only(points)[0], first) for r in np.ascontiguousarray(tf)]]

    def centred(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = vectors(np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(len(table), -1), idf)
        seen = ~table["apart"].to_numpy()
        c = centroids_of(x[seen] if seen.any() else x)
        return pa.table({"label": table["label"].slice(0, 1), "centroids": pa.array([c.tobytes()], pa.binary())})

    made = appended(texts_of(docs, chosen), rows_of, [("x", T.BinaryType())], "text").drop("text")
    made = written(made.withColumn("apart", F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(5)) == 0), "vectors")
    # a language's sample is at most ``limit`` rows; only its centroids come to the driver
    rows = made.groupBy("label").applyInArrow(centred, "label string, centroids binary").collect()
    rows.sort(key=lambda r: r.label)
    found = [np.frombuffer(r.centroids, np.float32).reshape(-1, 1 << BITS) for r in rows]
    owner = [k for k, c in enumerate(found) for _ in range(len(c))]
    model = Model([r.label for r in rows], idf, np.concatenate([np.zeros((0, 1 << BITS), np.float32), *found]), np.array(owner, int), np.zeros(len(rows)))
    model.reach = reaches(made, model)
    return model


def centroids_of(own: np.ndarray) -> np.ndarray:
    """Spherical k-means of one language's vectors."""
    c = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(own @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = own[near == j].mean(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c.astype(np.float32)


def reaches(made: DataFrame, model: Model) -> np.ndarray:
    """The distance up to which each language takes a text.

    Each held-back text gives two distances: to its own language, and to the other language that comes nearest, for
    which it is a stranger. Only these two numbers a text come to the driver.
    """
    shared = made.sparkSession.sparkContext.broadcast(model)
    code = {lang: k for k, lang in enumerate(model.langs)}

    def run(batches):
        m = shared.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            own = np.array([code[v] for v in batch.column("label").to_pylist()], int)
            for lo in range(0, len(own), ROWS):
                me = own[lo : lo + ROWS]
                cos = vectors(x[lo : lo + ROWS], m.idf) @ m.centroids.T
                mine = m.owner[None, :] == me[:, None]
                inside = np.where(mine, cos, -1.0).max(1)
                other = np.where(mine, -1.0, cos)
                near = m.owner[other.argmax(1)]
                columns = [np.r_[me, near], np.r_[1 - inside, 1 - other.max(1)].astype(np.float64), np.r_[np.ones(len(me), bool), np.zeros(len(me), bool)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "distance", "own"])

    # where none of a language is held back, those that its centroids have seen
    some = made.groupBy("label").agg(F.max("apart").alias("__some"))
    rows = made.join(F.broadcast(some), "label").where("apart = __some").select("label", "x").mapInArrow(run, "lang long, distance double, own boolean").toArrow()
    lang, distance, own = (rows[c].to_numpy() for c in ("lang", "distance", "own"))
    return np.array([best_cut(distance[(lang == k) & own], distance[(lang == k) & ~own & (distance <= 1)]) for k in range(len(model.langs))])


def best_cut(own: np.ndarray, strangers: np.ndarray) -> float:
    """The distance with the fewest own texts beyond it and strangers within it, as shares, in the middle of its gap."""
    edges = np.unique(np.concatenate([own, strangers, [0.0, 1.0]]))
    middle = (edges[1:] + edges[:-1]) / 2
    beyond = 1 - np.searchsorted(np.sort(own), middle) / max(len(own), 1)
    within = np.searchsorted(np.sort(strangers), middle) / max(len(strangers), 1)
    wrong = np.round(beyond + within, 9)
    best = np.flatnonzero(wrong == wrong.min())
    return float(min(middle[best[np.argmax(np.diff(edges)[best])]], FARTHEST))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected. A rejected text with letters still
    names its nearest language, so a caller may choose what to do with it. Rows are judged one by one, repeated ones
    alike, and by their whole texts; columns that bear the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(buf, offs):
        m = shared.value
        points, first = characters(buf, offs)
        points, letter = letters_only(points)
        some = np.zeros(len(points) + 1, np.int64)
        np.cumsum(letter, out=some[1:])
        some = (some[first[1:]] - some[first[:-1]] > 0) & (len(m.langs) > 0)
        best, near = np.zeros(len(some)), np.zeros(len(some), int)
        if m.langs:
            for lo, hi, tf in counts(points, first):
                cos = vectors(tf, m.idf) @ m.centroids.T
                near[lo:hi] = m.owner[np.argmax(cos, axis=1)]
                best[lo:hi] = cos.max(1)
        best = np.where(some, np.clip(best, 0, 1), 0.0)
        lang = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(near, some, strict=True)]
        far = ~some | (1 - best > m.reach[near] if m.langs else True)
        return [lang, best, far]

    return appended(docs, run, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], text_col)


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; see the contract of this operator."""
    held_out = fold("doc_id", 3) == 1
    return predict(docs.select("doc_id", "text"), fit(docs, held_out)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
