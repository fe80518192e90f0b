"""How five quality filters interact: a sparse document-term matrix decides two, flags the rest, orders are compared.

1. A global dictionary gives each distinct word of the corpus a code: the 64-bit hash of its bytes, which no other word
   has. Tasks send each batch's distinct words once; of words that share a hash all but the first in byte order get a
   free code, and these few are what tasks have to be told (for a hash of 64 bits, one expected among six billion words).
2. Tasks turn texts into shards of the document-term matrix in CSR form: row pointers, codes and counts. The sum of a
   row is the document's number of words, its number of entries the number of distinct ones; they decide A and B.
3. C, D and a digest of the whole text come from the same pass. Digests that several documents share decide E.
4. Documents become counts by part, failed filters and labels, at most 128 rows a part. Every order of the filters is
   applied to these.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.textarrays import LOW_BYTES, Words, appended, blocks, byte_hashes, eights
from quernstone.session import written

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
KNOWN = 1 << 20  # codes that a task remembers having sent; beyond, it forgets them and may send one again

# Fixed values of the contract: the characters of D.
MARKS = "#$%&*|"

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def dictionary(docs: DataFrame, hashed=byte_hashes) -> DataFrame:
    """(hash, word) of each distinct word of all texts, as bytes. ``hashed`` is for tests, which make words collide."""

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, _, buf, offs in blocks(batch.column(0)):
                words = Words(buf, offs)
                codes = hashed(buf, words.starts, words.ends)
                order = np.lexsort((words.ends - words.starts, codes))
                # neighbours of one hash are one word if their bytes are equal
                a, b = order[:-1], order[1:]
                same = (codes[a] == codes[b]) & equal_runs(buf, words, a, b)
                first = order[np.r_[True, ~same]] if len(order) else order
                alone = np.r_[True, codes[first[1:]] != codes[first[:-1]]] & np.r_[codes[first[1:]] != codes[first[:-1]], True] if len(first) else np.zeros(0, bool)
                out = []
                for i, code, single in zip(first.tolist(), codes[first].tolist(), alone.tolist(), strict=True):
                    if not single or code not in sent:
                        out.append(i)
                        if single:
                            sent.add(code)
                if len(sent) > KNOWN:
                    sent.clear()
                raw = buf.tobytes()
                found = [raw[words.starts[i] : words.ends[i]] for i in out]
                yield pa.RecordBatch.from_arrays([pa.array(codes[out].view(np.int64), pa.int64()), pa.array(found, pa.binary())], names=["hash", "word"])

    return docs.select("text").mapInArrow(run, "hash long, word binary").distinct()


def equal_runs(buf: np.ndarray, words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] have the same bytes: eight bytes a step, of those that are equal so far."""
    n = words.ends - words.starts
    same = n[a] == n[b]
    view, done = eights(buf), 0
    at = np.flatnonzero(same)
    while len(at):
        i, j, left = a[at], b[at], n[a[at]] - done
        mask = LOW_BYTES[np.minimum(left, 8)]
        equal = (view[words.starts[i] + done] & mask) == (view[words.starts[j] + done] & mask)
        same[at[~equal]] = False
        at, done = at[equal & (left > 8)], done + 8
    return same


def exceptions(words: DataFrame) -> dict[bytes, int]:
    """Codes of the words whose hash another word has, but for the first of each hash: negative numbers from -1 on.

    Hashes are unsigned, so negative codes are free. Only words that collide reach the driver.
    """
    shared = words.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    rows = sorted((r.hash, bytes(r.word)) for r in words.join(shared, "hash").select("hash", "word").collect())
    later = [w for (h, w), (before, _) in zip(rows[1:], rows[:-1], strict=True) if h == before]
    return {w: -1 - i for i, w in enumerate(later)}


def shard(buf: np.ndarray, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row pointers, codes, counts) of the document-term matrix of a block's rows."""
    pointers, indices, counts = [0], [], []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = np.sort(codes[lo:hi])
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
        indices.append(own[new])
        counts.append(np.diff(np.append(new, len(own))))
        pointers.append(pointers[-1] + len(new))
    none = np.zeros(0, np.int64)
    return np.array(pointers), np.concatenate([none.astype(codes.dtype), *indices]), np.concatenate([none, *counts])


def flagged(docs: DataFrame, hashed=byte_hashes) -> DataFrame:
    """``docs`` without its text, with n_words, n_distinct, flags (of A to D, bits 0 to 3) and digest of each text."""
    special = exceptions(written(dictionary(docs, hashed), "dictionary"))
    shared = docs.sparkSession.sparkContext.broadcast(special)

    def run(buf, offs):
        words = Words(buf, offs)
        codes = hashed(buf, words.starts, words.ends)
        if shared.value:
            raw, codes = buf.tobytes(), codes.astype(object)
            for i in range(len(codes)):
                codes[i] = shared.value.get(raw[words.starts[i] : words.ends[i]], codes[i])
        pointers, _, counts = shard(buf, words, codes)
        upto = np.r_[0, np.cumsum(counts)]
        n_words, n_distinct = upto[pointers[1:]] - upto[pointers[:-1]], np.diff(pointers)

        def number(mask):
            upto = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(mask, out=upto[1:])
            return upto[offs[1:]] - upto[offs[:-1]]

        points = number((buf & 0xC0) != 0x80)
        fails = [n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT_PERCENT * n_words, 100 * number(_UPPER[buf]) > MAX_UPPER_PERCENT * points, number(_MARK[buf]) > 0]
        raw = buf.tobytes()
        digests = [sha256(raw[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return [n_words, n_distinct, sum(f.astype(np.int32) << i for i, f in enumerate(fails)), digests]

    fields = [("n_words", T.LongType()), ("n_distinct", T.LongType()), ("flags", T.IntegerType()), ("digest", T.BinaryType())]
    return appended(docs, run, fields).drop("text")


def failures(docs: DataFrame, hashed=byte_hashes) -> DataFrame:
    """(doc_id, part, fails): the filters that each document fails, bit i for filter i.

    Of documents with one text all but those with the smallest id fail E; a null id has no order and never fails it.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    rows = written(flagged(plain, hashed), "flagged")
    lots = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    rows = rows.join(written(lots, "copies"), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False)).cast("int")
    return rows.select("doc_id", "part", F.col("flags").bitwiseOR(F.shiftleft(copy, 4)).alias("fails"))


def tallied(docs: DataFrame, labels: DataFrame, hashed=byte_hashes) -> DataFrame:
    """(part, fails, good, toxic, n): documents by part, failed filters and labels.

    A document is good or toxic if any of its labels says so with a 1; without a label it is neither.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, hashed)
    rows = rows.join(marks, rows.doc_id == marks["__id"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.select("part", "fails", *flags).groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))


def audited(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(place):
        return F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), F.substr("filter_order", place, F.lit(1)))

    own = bit(F.col("step"))
    earlier = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("step") > k, bit(F.lit(k))).otherwise(0) for k in range(1, len(FILTERS))])
    rows = rows.withColumns({"own": own, "earlier": earlier})
    fails, gone = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("earlier")) != 0
    here = fails & ~gone

    def number(when, n=F.col("n")):
        return F.sum(F.when(when, n).otherwise(0)).cast("long")

    out = rows.groupBy("part", "filter_order", "step").agg(
        number(~fails & ~gone).alias("kept"), number(here).alias("removed"), number(fails & gone).alias("redundant"), number(F.col("fails") == F.col("own")).alias("unique_fails"),
        number(here & F.col("good")).alias("good_lost"), number(here & F.col("toxic")).alias("toxic_lost"),
        # the first of a document's k failed filters removes it: each is first in one order of k
        number(fails, F.col("n") * F.floor(F.lit(120) / F.greatest(F.bit_count("fails"), F.lit(1)))).alias("shapley"),
    )
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).

    A null or empty text has no words and fails A alone, and E if a smaller id has such a text too; a null lang is the
    part of the empty string. Texts are read whole, whatever their length; repeated rows count as often as they occur,
    and as no copies of one another. Other columns are not read. A table without documents has no parts and no rows.
    """
    return audited(tallied(docs, labels))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``documents``; see the contract of this operator."""
    return audit(docs, labels)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
    SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM d
),
m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN m ON m.doc_id = f.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN fails & (own | earlier) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & own <> 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails & own <> 0 AND fails & earlier <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN good AND fails & own <> 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND fails & own <> 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
