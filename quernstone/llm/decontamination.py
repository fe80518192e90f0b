"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a latent space for each block of items:
   tasks multiply their passages with a small dense matrix, only feature-by-rank sums meet.
3. Every passage of every document is projected; benchmark passages with a large cosine are candidates. The cosine
   takes the document passage's whole length, so text outside the latent space is far from everything in it.
4. Candidates are checked word by word: the longest common subsequence with the benchmark item around the passage,
   and for paraphrases below the plain threshold also the item's answer, its last sentence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.textarrays import Words, blocks, folded, free_name, mix
from quernstone.session import written

BITS = 15
FEATURES = 1 << BITS
HALF = 16  # passages are two halves of this many words and start at every half
RANK = 112
OVERSAMPLE = 16
CHUNK = 512  # features whose partial sums travel together
ITEMS = 256  # benchmark items of one latent space
SPACES = 16  # latent spaces that one pass over the documents searches
COSINE = 0.1
LCS = 0.8  # share of the item's words found in order: a copy
PARAPHRASE = 0.6  # with this share, the answer decides
ANSWER = 0.8
SEED = 11


# first byte, second byte, lowest and highest third byte of white space beyond ASCII, as str.split() takes it
_SPACES = [(0xC2, 0x85, None, None), (0xC2, 0xA0, None, None), (0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8A), (0xE2, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0xAF, 0xAF), (0xE2, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80)]


def plain_spaces(buf: np.ndarray) -> np.ndarray:
    """The bytes with every white space of Unicode as spaces, as many as its bytes."""
    out = np.where((buf >= 0x1C) & (buf <= 0x1F), 0x20, buf).astype(np.uint8)
    for first, second, low, high in _SPACES:
        at = np.flatnonzero(buf[:-1] == first)
        at = at[buf[at + 1] == second]
        if low is not None:
            at = at[at + 2 < len(buf)]
            at = at[(buf[at + 2] >= low) & (buf[at + 2] <= high)]
            out[at + 2] = 0x20
        out[at], out[at + 1] = 0x20, 0x20
    return out


def plain(column: pa.Array):
    """As :func:`blocks`, with the texts in lower case and with plain spaces: the words of a block are those of
    :func:`words_of`, one by one, for features, places and subsequences alike."""
    for lo, hi, buf, offs in blocks(column):
        if (buf >= 0x80).any():
            raw = buf.tobytes()
            rows = [raw[a:b].decode("utf-8", "replace").lower().encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            buf, offs = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
        else:
            buf = folded(buf)
        yield lo, hi, plain_spaces(buf), offs


def features(words: Words) -> np.ndarray:
    return (mix(words.hashes() + np.uint64(3)) >> np.uint64(64 - BITS)).astype(np.int32)


def halves(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids as rows of HALF, each document padded to whole rows with the id FEATURES; and each row's document."""
    n = words.counts()
    rows = -(-n // HALF)
    first = np.cumsum(rows) - rows
    out = np.full(int(rows.sum()) * HALF, FEATURES, np.int32)
    doc = words.rows()
    out[first[doc] * HALF + np.arange(len(ids)) - words.first[:-1][doc]] = ids
    return out.reshape(-1, HALF), np.repeat(np.arange(len(n)), rows)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, over all of them."""

    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        last = np.full(FEATURES, -1, np.int64)
        for batch in batches:
            for lo, hi, buf, offs in plain(batch.column(0)):
                words = Words(buf, offs)
                ids, doc = features(words), words.rows()
                n += hi - lo
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    part = ids[a:b]
                    last[part] = np.arange(a, b)
                    df[part[last[part] == np.arange(a, b)]] += 1
                last[:] = -1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    out, n = np.zeros(FEATURES), 0
    for r in docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        if r.feature < 0:
            n = r.df
        else:
            out[r.feature] = r.df
    return out, n


def passage_vectors(rows: np.ndarray, doc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each half, the sum of the table's rows over the passage that starts there (this half and the next)."""
    half = np.empty((len(rows), table.shape[1]), np.float32)
    for lo in range(0, len(rows), 1024):
        half[lo : lo + 1024] = table[rows[lo : lo + 1024]].sum(1)
    if len(rows) > 1:
        same = doc[1:] == doc[:-1]
        half[:-1][same] += half[1:][same]
    return half


def gram_times(passages: DataFrame, idf: np.ndarray, inside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A' A X for the normalised TF-IDF matrix A of the passages: each task adds up its passages, chunks meet by key.

    ``inside`` are the features that the passages have, in order; ``x`` has a row for each.
    """
    m, rank = x.shape
    place = np.full(FEATURES + 1, m, np.int32)  # padding has the last row, which stays zero
    place[inside] = np.arange(m)
    shared = passages.sparkSession.sparkContext.broadcast((np.append(x, np.zeros((1, rank), np.float32), 0), np.append(idf[inside], 0), place))

    def run(batches):
        t, w, to = shared.value
        total = np.zeros((m + 1, rank), np.float64)
        for batch in batches:
            for _, _, buf, offs in plain(batch.column(0)):
                words = Words(buf, offs)
                rows, doc = halves(words, features(words))
                rows = to[rows]
                for lo in range(0, len(rows), 2048):
                    ids = rows[lo : lo + 2048]
                    nxt = np.full_like(ids, m)
                    part = rows[lo + 1 : lo + 1 + len(ids)]
                    nxt[: len(part)] = np.where((doc[lo + 1 : lo + 1 + len(ids)] == doc[lo : lo + len(part)])[:, None], part, m)
                    both = np.sort(np.concatenate([ids, nxt], 1), 1)
                    flat = (both + np.arange(len(both))[:, None] * (m + 1)).ravel()
                    cell, count = np.unique(flat, return_counts=True)
                    at, f = cell // (m + 1), cell % (m + 1)
                    value = np.sqrt(count) * w[f]
                    norm = np.sqrt(np.bincount(at, value**2, len(both)))
                    value /= np.maximum(norm, 1e-12)[at]
                    y = np.zeros((len(both), rank))
                    np.add.at(y, at, value[:, None] * t[f])
                    np.add.at(total, f, value[:, None] * y[at])
        for c in np.unique(np.flatnonzero(total[:-1].any(1)) // CHUNK).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([total[c * CHUNK : min((c + 1) * CHUNK, m)].astype(np.float32).tobytes()])], names=["chunk", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.float32).astype(np.float64) for p in table.column("part"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    parts = passages.select("text").mapInArrow(run, "chunk long, part binary").groupBy("chunk").applyInArrow(add, "chunk long, part binary")
    out = np.zeros((m, rank), np.float32)
    for r in parts.collect():  # a row a feature of the block's items
        part = np.frombuffer(r.part, np.float32).reshape(-1, rank)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    shared.destroy()
    return out


def orthonormal(x: np.ndarray) -> np.ndarray:
    """``x`` with orthonormal columns, in place, by Cholesky factors of its small Gram matrix.

    The second pass mends what rounding leaves of the first; the small ridge serves ranks below the column count.
    """
    for _ in range(2):
        g = np.zeros((x.shape[1], x.shape[1]))
        for lo in range(0, len(x), CHUNK):
            part = x[lo : lo + CHUNK].astype(np.float64)
            g += part.T @ part
        g += np.eye(len(g)) * (1e-7 * np.trace(g) / len(g) + 1e-30)
        inverse = np.linalg.inv(np.linalg.cholesky(g)).T
        for lo in range(0, len(x), CHUNK):
            x[lo : lo + CHUNK] = x[lo : lo + CHUNK] @ inverse
    return x


def latent_space(items: DataFrame, idf: np.ndarray, inside: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The idf-weighted latent vector of each feature in ``inside``, those that the items have.

    The randomised SVD of the items' passages takes two power iterations. A feature of no item has no part in them.
    """
    rng = np.random.default_rng(SEED)
    q = orthonormal(rng.standard_normal((len(inside), rank + OVERSAMPLE), np.float32))
    for _ in range(2):
        q = orthonormal(gram_times(items, idf, inside, q))
    small = q.T @ gram_times(items, idf, inside, q)
    _, vectors = np.linalg.eigh((small + small.T).astype(np.float64) / 2)
    return q @ vectors[:, ::-1][:, :rank].astype(np.float32) * idf[inside].astype(np.float32)[:, None]


def features_of(texts: list[str]) -> np.ndarray:
    """The distinct features of all words of the texts."""
    found = [features(Words(buf, offs)) for _, _, buf, offs in plain(pa.array(texts, pa.string()))]
    return np.unique(np.concatenate([np.zeros(0, np.int32), *found]))


def words_of(text: str) -> list[str]:
    """The words of a text: what white space of any kind parts, in lower case."""
    return text.lower().split()


def answer_of(words: list[str]) -> list[str]:
    """The words of the last sentence."""
    ends = [i for i, w in enumerate(words[:-1]) if re.search(r"[.!?:]$", w)]
    return words[ends[-1] + 1 :] if ends else words


def common_subsequence(item: dict[str, int], length: int, text: list[str]) -> int:
    """Length of the longest common subsequence; ``item`` has a bit for each place of a word. One step a text word."""
    row = (1 << length) - 1
    full = row
    for w in text:
        m = item.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - bin(row).count("1")


def bits_of(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """A block of benchmark items: their passages in the latent space and their words for the checks.

    Features that no item has lie outside the space, so only those of the items keep a vector.
    """

    def __init__(self, ids: list[int], texts: list[str], inside: np.ndarray, table: np.ndarray):
        self.ids = ids
        self.words = [words_of(t) for t in texts]
        self.bits = [bits_of(w) for w in self.words]
        self.spare = [len(w) - len(b) for w, b in zip(self.words, self.bits, strict=True)]
        self.answers = [answer_of(w) for w in self.words]
        self.answer_bits = [bits_of(w) for w in self.answers]
        self.place = np.zeros(FEATURES + 1, np.int32)
        self.place[inside] = np.arange(1, len(inside) + 1)
        self.table = np.concatenate([np.zeros((1, table.shape[1]), np.float32), table])
        vectors, owner = [], []
        for lo, _, buf, offs in plain(pa.array(texts, pa.string())):
            words = Words(buf, offs)
            rows, doc = halves(words, features(words))
            v = passage_vectors(self.place[rows], doc, self.table)
            last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
            alone = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else last
            keep = ~last | alone  # the last half is within the passage before it
            vectors.append(v[keep])
            owner.append(doc[keep] + lo)
        v = np.concatenate(vectors) if vectors else np.zeros((0, table.shape[1]), np.float32)
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, int)

    def may_hold(self, k: int, present: set[str]) -> bool:
        """Whether a text with these words can have enough of the item's words, in whatever order."""
        return self.spare[k] + len(self.bits[k].keys() & present) >= PARAPHRASE * len(self.words[k])

    def check(self, k: int, text: list[str]) -> tuple[float, float, bool]:
        """(share of the item's words in order, share of its answer's words in order, whether that is contamination)."""
        n = len(self.words[k])
        share = common_subsequence(self.bits[k], n, text) / n
        answer = common_subsequence(self.answer_bits[k], len(self.answers[k]), text) / max(len(self.answers[k]), 1) if share >= PARAPHRASE else 0.0
        return share, answer, share >= LCS or share >= PARAPHRASE and answer >= ANSWER


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs, answer): each document and benchmark item that it holds, copied or paraphrased.

    Words are parted by any white space of Unicode. Null and empty texts hold nothing, null or empty items are held by
    nothing; repeated rows of either table count once. The benchmark is taken in blocks of about ITEMS items, SPACES blocks a pass, so what tasks get is bounded.
    """
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    items = written(items.where(F.col("text").rlike(r"(?U)\S")), "items")
    share = max(1, -(-items.count() // ITEMS))
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    squares = np.append(idf**2, 0).astype(np.float32)
    found = None
    for lo in range(0, share, SPACES):
        spaces = []
        for part in range(lo, min(lo + SPACES, share)):
            block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(share)) == part).coalesce(4)  # a few hundred rows
            rows = block.orderBy("item_id").collect()
            texts = [r.text for r in rows]
            inside = features_of(texts)
            spaces.append(Items([r.item_id for r in rows], texts, inside, latent_space(block, idf, inside)))
        shared = docs.sparkSession.sparkContext.broadcast((spaces, squares))
        hits = docs.select("doc_id", "text").mapInArrow(_search(shared), "doc_id long, item_id long, lcs double, answer double")
        found = hits if found is None else found.union(hits)
    return found.groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _search(shared):
    def run(batches):
        for batch in batches:
            spaces, squares = shared.value
            out = []
            for lo, hi, buf, offs in plain(batch.column(1)):
                words = Words(buf, offs)
                rows, doc = halves(words, features(words))
                if len(rows):
                    first_half = np.searchsorted(doc, np.arange(hi - lo))
                    own = squares[rows].sum(1)
                    own[:-1] += np.where(doc[1:] == doc[:-1], own[1:], 0)
                    for items in spaces:
                        out += [(lo + r, *found) for r, *found in _held(items, rows, own, doc, first_half, buf, offs)]
            if out:
                rows_, ids, lcs, answer = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), pa.array(ids, pa.int64()), pa.array(lcs, pa.float64()), pa.array(answer, pa.float64())], names=["doc_id", "item_id", "lcs", "answer"])

    return run


def _held(items: Items, rows: np.ndarray, own: np.ndarray, doc: np.ndarray, first_half: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> list[tuple]:
    """(row, item id, share of words, share of the answer) of the items that the rows of a block hold.

    Candidates of one row and item that lie within a quarter of the item's length are checked together, in the window
    that covers those of each, so the work for a long item grows with the text and not with its square.
    """
    if not len(items.owner):
        return []
    v = passage_vectors(items.place[rows], doc, items.table)
    near = []
    for a in range(0, len(v), 4096):
        part = v[a : a + 4096]
        p, q = np.nonzero(part @ items.vectors.T >= COSINE * np.sqrt(np.maximum(own[a : a + 4096, None], 1e-9)))
        near.append(np.stack([p + a, items.owner[q]], 1))
    near = np.unique(np.concatenate(near), axis=0)
    step = np.maximum(1, np.array([len(w) for w in items.words]) // (4 * HALF))[near[:, 1]]
    group = np.stack([doc[near[:, 0]], (near[:, 0] - first_half[doc[near[:, 0]]]) // step, near[:, 1]], 1)
    order = np.lexsort(group.T[::-1])
    near, group = near[order], group[order]
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]) if len(group) else np.zeros(0, int)
    low = near[new, 0]
    high = near[np.append(new[1:] - 1, len(near) - 1), 0] if len(new) else low
    text, text_row, seen, present = [], -1, None, set()
    best: dict[tuple[int, int], tuple[float, float]] = {}
    for r, p, q, k in zip(group[new, 0].tolist(), low.tolist(), high.tolist(), group[new, 2].tolist(), strict=True):
        if best.get((r, k), (0.0, 0.0))[0] == 1.0:
            continue
        if r != text_row:
            text, text_row, seen = buf[offs[r] : offs[r + 1]].tobytes().decode().split(), r, None
        reach, begin = len(items.words[k]), first_half[r]
        lo, hi = max(0, (p - begin) * HALF - reach), (q - begin) * HALF + 2 * HALF + reach
        if seen is None or lo < seen[0] or hi > seen[1]:  # the words of a window serve its neighbours as well
            seen = max(0, lo - 4 * HALF), hi + 4 * HALF
            present = set(text[seen[0] : seen[1]])
        if not items.may_hold(k, present):
            continue
        share, answer, bad = items.check(k, text[lo:hi])
        if bad and (share, answer) > best.get((r, k), (0.0, 0.0)):
            best[r, k] = share, answer
    return [(r, items.ids[k], s, a) for (r, k), (s, a) in best.items()]


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows with a null id stay."""
    name = free_name("__bad", docs.columns)
    bad = written(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).dropna().distinct(), "contaminated")
    return docs.join(bad, docs.doc_id == bad[name], "left_anti")


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs, answer of every contaminated document and what it holds."""
    return contaminated(docs, benchmark)
