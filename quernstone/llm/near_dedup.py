"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles; equal sets are one class, represented by the smallest id.
2. Representatives get MinHash signatures; banding puts them into buckets.
3. Pairs from buckets are compared batch by batch of the signature. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below the chosen miss probability.
4. Survivors are verified exactly on their full shingle sets; verified pairs are links, components follow.

Pairs of a bucket are made in rounds. In each of the first ROUNDS a member meets one centre of each of its buckets,
drawn at random. A bucket whose members are then all in one component needs no more pairs, as its other links cannot
change a component. The documents of the remaining buckets get an exact prefix join: a pair that reaches the threshold
must share a shingle early in the order of rising frequency, so only pairs of different components that do are made.
Large groups of near copies thus cost about one pair a member and bucket, large groups of documents that merely share
some text make no pairs, and no pair that could join two components stays uncompared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import components
from quernstone.llm.textarrays import Words, blocks, digest, free_name, mix, runs
from quernstone.session import written

BANDS = 40
BAND_ROWS = 6  # a pair at similarity 0.8 shares no band with probability 5e-6, at 0.85 with 6e-9
HASHES = BANDS * BAND_ROWS
BATCH = 40  # hashes compared before each look at the posterior
MISS = 1e-6
ROUNDS = 2

_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the offset of each row in them.

    Words are lower-cased in A-Z. A row with fewer words than ``size`` has its whole sequence as one shingle.
    """
    words = Words(buf, offs)
    h = words.hashes(fold_case=True)
    n = words.counts()
    row = words.rows()
    at = np.flatnonzero(row[: len(h) - size + 1] == row[size - 1 :]) if len(h) >= size else np.zeros(0, np.int64)
    s, row = runs(h, size)[at], row[at]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        whole = [runs(h[words.first[r] : words.first[r + 1]], int(n[r]))[0] for r in few]
        s, row = np.append(s, np.array(whole, np.uint64)), np.append(row, few)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def signatures(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values of every row that has shingles."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    some = first[:-1][first[1:] > first[:-1]]
    out = np.empty((len(some), HASHES), np.uint16)
    if len(some):
        h = np.empty_like(x)
        for k in range(HASHES):
            np.bitwise_xor(x, _XOR[k], out=h)
            np.multiply(h, _MUL[k], out=h)
            m = np.minimum.reduceat(h, some)
            m *= np.uint32(0x9E3779B1)
            out[:, k] = m >> np.uint32(16)
    return out


def sketched(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, set1, set2, signature); rows without shingles have n = 0 and no signature.

    (set1, set2) is the digest of all shingles in order, so equal ones are equal sets.
    """

    def run(batches):
        for batch in batches:
            parts = []
            for lo, hi, buf, offs in blocks(batch.column(1)):
                s, first = shingles(buf, offs, size)
                n = np.diff(first)
                has = n > 0
                raw = memoryview(s).cast("B")
                sets = np.frombuffer(b"".join([digest(raw[8 * a : 8 * b]) for a, b in zip(first[:-1], first[1:], strict=True)]), "<i8").reshape(-1, 2)
                sig = np.full(hi - lo, None, object)
                sig[has] = [x.tobytes() for x in signatures(s, first)]
                parts.append(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(sig, pa.binary())], names=["doc_id", "n", "set1", "set2", "signature"]))
            yield from parts

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, set1 long, set2 long, signature binary")


def banded(rows: DataFrame) -> DataFrame:
    """(bucket, doc_id, n): a row for each band of each signature."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, BANDS, BAND_ROWS)
                key = np.zeros(sig.shape[:2], np.uint64)
                for k in range(BAND_ROWS):
                    key = mix(key * np.uint64(65537) + sig[:, :, k].astype(np.uint64))
                key = mix(key + np.arange(BANDS, dtype=np.uint64)[None, :])
                again = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), part.column("doc_id").take(again), part.column("n").take(again)], names=["bucket", "doc_id", "n"])

    return rows.select("doc_id", "n", "signature").mapInArrow(run, "bucket long, doc_id long, n long")


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): with fewer, P(similarity >= threshold) is below ``miss``.

    The prior is uniform, so after m matches of n the similarity follows Beta(m + 1, n - m + 1).
    """
    j = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(j) + (n - m) * np.log1p(-j)
            weight = np.exp(logs - logs.max())
            if weight[j >= threshold].sum() >= miss * weight.sum():
                out.append((n, m))
                break
    return out


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that no look at the posterior drops."""
    looks = least_matches(threshold, miss)
    left = sketches.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
                alive, matches, done = np.arange(part.num_rows), np.zeros(part.num_rows, int), 0
                for n, least in looks:
                    matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
                    going = matches >= least
                    alive, matches, done = alive[going], matches[going], n
                at = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = []
                for c in ("ta", "tb"):
                    for _, _, buf, offs in blocks(part.column(c)):
                        s, first = shingles(buf, offs, size)
                        sets += [s[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                keep = []
                for x, y in zip(sets[: part.num_rows], sets[part.num_rows :], strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                part = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A null or empty text, or one of white space alone, has no shingles and is linked with nothing. Repeated rows are
    exact copies of each other. A row with a null id forms no link and has a null component.
    """
    sketches = written(sketched(docs, size, id_col, text_col), "sketches")
    known = sketches.where("n > 0 and doc_id is not null")
    keys = ["n", "set1", "set2"]
    classes = written(known.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    bands = banded(reps)
    sizes = written(bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    members = written(bands.join(sizes, "bucket"), "members")
    involved = members.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(involved, "doc_id", "left_semi")
    texts = written(texts, "texts")

    left, labels, done = members.withColumn("label", F.col("doc_id")), None, None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = drawn(left, percent, turn)
        else:
            pairs = prefix_pairs(left.groupBy("doc_id").agg(F.max("label").alias("label")), texts, size, percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        done = pairs if done is None else done.union(pairs)
        links = written(verified(likely(pairs, known, percent / 100, miss), texts, size, percent), "links")
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            labels = relabelled(labels, links)
        if turn == ROUNDS:
            break
        own = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        own = own.select("bucket", "doc_id", "n", "m", F.coalesce("label", "doc_id").alias("label"))
        open_ = own.where("m > 2").groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        left = written(own.join(written(open_.select("bucket"), "open"), "bucket", "left_semi"), "left")
        if left.isEmpty():
            break

    rep = sketches.join(classes, keys, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    out = rep.join(labels, rep.rep == labels.node, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("component_id"))


def drawn(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each member with a random member of its bucket, if their sizes allow the similarity."""
    lot = F.xxhash64(F.lit(19 + turn), "bucket", "doc_id")
    centre = members.groupBy("bucket").agg(F.min(F.struct(lot.alias("lot"), "doc_id", "n", "label")).alias("c"))
    centre = written(centre.select("bucket", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("cn"), F.col("c.label").alias("cl")), "centres")
    # at first all labels differ but of the centre itself
    near = members.join(centre, "bucket").where(f"label <> cl and 100 * least(n, cn) >= {percent} * greatest(n, cn)")
    return near.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()


def exploded(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, label, n, s): a row for each distinct shingle of each text."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column("text")):
                s, first = shingles(buf, offs, size)
                row = pa.array(np.repeat(np.arange(lo, hi), np.diff(first)))
                n = np.repeat(np.diff(first), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("label").take(row), pa.array(n), pa.array(s.view(np.int64))], names=["doc_id", "label", "n", "s"])

    return texts.mapInArrow(run, "doc_id long, label long, n long, s long")


def prefix_pairs(labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs (a, b) of documents with different labels that may reach the similarity, by the prefix filter.

    With the shingles of each set in order of rising frequency, the first common one of a pair with intersection o
    leaves at least o - 1 after it in both sets, and o >= p / (100 + p) * (n + m). So the larger set is looked up with
    its first n - p n / 100 + 1 shingles among the first n - 2 p n / (100 + p) + 1 of smaller ones. Shingles of a
    single document match nothing and only take places. Each pair has a member outside the label that is most frequent
    at the shingle; pairs within that label are not made. A shingle that many documents hold is split by their sizes.
    """
    rows = exploded(texts.join(labels, "doc_id").dropDuplicates(["doc_id"]), size)
    common = written(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    ordered = rows.join(common, "s").groupBy("doc_id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("list"))
    probe = F.expr(f"n - ceil({percent} * n / 100)").cast("int")  # the last place, from zero, that a common shingle may have
    skipped = F.col("n") - F.size("list")
    ordered = ordered.select("doc_id", "label", "n", skipped.alias("skipped"), F.posexplode(F.slice("list", F.lit(1), F.greatest(probe + 1 - skipped, F.lit(0)).cast("int"))).alias("pos", "e"))
    prefix = written(ordered.select("doc_id", "label", "n", F.col("e.s").alias("s"), (F.col("skipped") + F.col("pos")).alias("i")), "prefix")
    per = prefix.groupBy("s", "label").agg(F.count("*").alias("c")).groupBy("s").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    per = written(per.where("labels > 1").select("s", F.col("top.label").alias("top")), "top")
    prefix = written(prefix.join(per, "s").withColumn("minor", F.col("label") != F.col("top")).drop("top"), "prefix")
    # sizes of a pair differ by a factor of 100 / percent at most, so pairs meet within a class of sizes and the next
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    size_class = F.floor(F.log(F.col("n")) / step + 1e-9).cast("int")
    y = prefix.where(F.expr(f"i <= n - ceil({2 * percent} * n / {100 + percent})"))
    y = y.select("s", size_class.alias("sizes"), F.col("doc_id").alias("yd"), F.col("label").alias("yl"), F.col("n").alias("yn"), F.col("i").alias("yi"), F.col("minor").alias("ym"))
    larger = prefix.withColumn("sizes", F.explode(F.array(size_class, size_class - 1)))
    fits = F.expr(f"label <> yl and (yn < n or yn = n and yd < doc_id) and 100 * yn >= {percent} * n and least(n - i, yn - yi) * {100 + percent} >= {percent} * (n + yn)")
    one = larger.where("minor").join(y, ["s", "sizes"]).where(fits)
    two = larger.where("not minor").join(y.where("ym"), ["s", "sizes"]).where(fits)
    both = one.union(two)
    return both.select(F.least("doc_id", "yd").alias("a"), F.greatest("doc_id", "yd").alias("b")).distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the graph whose nodes are the labels so far."""
    def to(col):
        return labels.select(F.col("node").alias(col), F.col("label").alias("l" + col))

    contracted = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
    contracted = contracted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    over = components(contracted).select(F.col("node").alias("was"), F.col("label").alias("now"))
    old = labels.join(over, labels.label == over.was, "left").select("node", F.coalesce("now", "label").alias("label"))
    fresh = over.join(labels, over.was == labels.node, "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return written(old.unionByName(fresh), "labels")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows with a null id stay."""
    gone = near_duplicates(docs, size, percent, id_col=id_col, text_col=text_col).where("doc_id <> component_id")
    name = free_name("__gone", docs.columns)
    gone = written(gone.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on 4-word shingles; see the contract."""
    out = near_duplicates(docs, size=4, percent=80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP4_SQL = r"""
WITH RECURSIVE listed AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
held AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM listed WHERE len(w) > 0)
),
sized AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
    SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reached AS (SELECT a AS doc_id, a AS other FROM edge UNION SELECT reached.doc_id, edge.b FROM reached JOIN edge ON edge.a = reached.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM listed LEFT JOIN sized USING (doc_id) LEFT JOIN component USING (doc_id)
"""
