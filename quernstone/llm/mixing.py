"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

1. Each source's documents are shuffled by an MD5 of their ids and laid end to end as one stream of words. The stream
   is cut into blocks of ``BLOCK`` words; one pass over a source takes its blocks in order, and a source is passed over
   at most ``MOST_PASSES`` times.
2. A source's target is its weight's share of all words, capped at so many passes; what the caps cut off is shared
   again by weight. All that is one sort of the sources by the share at which their cap binds.
3. The schedule has a slot for each block that a target needs. Slot i has the point (i * golden ratio) mod 1, kept as a
   whole number of 31 bits; the point lies in one source's share of the cumulative slots, so after any number of slots
   each source has had its share to within a few blocks.
4. Slots are ranked within their source, in two levels: counts of runs of slots are added up, then slots within a run
   are numbered. The rank gives pass and block. A source that the points serve a few slots too often loses the last
   ones, one that they serve too seldom has its last ones at the end; the last slot of a source is cut at the target.
5. Slots and the documents' parts of blocks are joined on (source, block).

Identical rows of (id, source, size) are one run of the stream with a count until they are dealt out, so no repeated
row and no source is ever gathered in one task: a source is split into buckets of about ``BUCKET`` such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import written

BLOCK = 1024  # words
BUCKET = 4096  # rows of a source that one window orders
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MOST_PASSES = 3
SEED = 11
POINTS = 31  # bits of a point
# odd number nearest to 2**31 / golden ratio: steps of it visit every point once
STEP = 1327217885
LEAST_CELLS = 1024
LEAST_RUN = 12  # bits: slots of which the counts are added up

WORD = r"[^\x20\x09-\x0D]+"


def order_key(seed: int) -> Column:
    """32 bits that shuffle the rows; the row's id and size decide."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, size, h, copies): distinct rows with their number of words; a null text has none."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("source").cast("string").alias("source"), "doc_id", size.alias("size"))
    rows = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    return written(rows.select("*", order_key(seed).alias("h")), "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES, block: int = BLOCK) -> DataFrame:
    """A row a source: source, rank, source_size, rows, target, take, blocks, slots, and low and high of all slots.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. A source binds where ``passes`` times
    its size is below its share; sorted by size over weight, bound ones come first, and the first one that is not bound
    tells the level of all that follow. ``take`` is the target in whole words, ``slots`` the blocks that it needs.
    """
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("rank", rank.cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * passes).withColumn("order", F.struct((F.col("cap") / F.col("weight")).alias("c"), "rank"))
    before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("order").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumns({"left": left.cast("double"), "weights": F.sum("weight").over(after)})
    free = F.when(F.col("cap") * F.col("weights").cast("double") >= F.col("weight") * F.col("left"), F.struct("order", "left", "weights"))
    per = per.withColumn("level", F.min(free).over(every))
    share = F.least(F.col("weight") * F.col("level.left") / F.col("level.weights"), F.col("cap").cast("double"))
    per = per.withColumn("target", F.when(F.col("order") < F.col("level.order"), F.col("cap").cast("double")).otherwise(share))
    per = per.withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumns({"whole": whole, "rest": F.col("take") - whole * F.col("source_size")})
    per = per.withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"upto": F.sum("slots").over(up), "all": F.sum("slots").over(every)})
    bounds = [F.floor(F.try_divide(F.lit(2.0**POINTS) * c, F.col("all"))).cast("long") for c in (F.col("upto") - F.col("slots"), F.col("upto"))]
    per = per.withColumns({"low": F.coalesce(bounds[0], F.lit(0)), "high": F.coalesce(bounds[1], F.lit(0))})
    keep = ["source", "rank", "source_size", "rows", "target", "take", "blocks", "whole", "rest", "slots", "low", "high"]
    return written(per.select(*keep), "targets")


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and ``start``, the words of the source's stream before the row.

    Two levels of sums: of buckets by key, then of rows within a bucket.
    """
    of = sources.select(F.col("source").alias("__s"), "rank", "source_size", "target", F.col("rows").alias("__n"))
    rows = rows.join(of, rows.source.eqNullSafe(of["__s"])).drop("__s")
    buckets = F.floor(F.col("__n") / BUCKET) + 1
    rows = written(rows.withColumn("bucket", F.shiftright(F.col("h") * buckets, 32)).withColumn("words", F.col("size") * F.col("copies")).drop("__n"), "dealt")
    per = rows.groupBy("rank", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__o")), "offsets")
    within = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__w", F.coalesce(F.sum("words").over(within), F.lit(0)))
    return rows.join(offsets, ["rank", "bucket"]).withColumn("start", F.col("__o") + F.col("__w")).drop("__o", "__w", "words", "bucket", "h")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, pass, block, length): which block each slot takes; ``length`` cuts the last one at the target."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    n, bits = total.n, LEAST_RUN
    while 1 << 2 * bits < n:  # as many runs as slots in a run
        bits += 1
    cells = LEAST_CELLS
    while cells < total.sources:
        cells *= 2
    width = (1 << POINTS) // cells
    # each cell of points lists the sources whose share touches it: an equi-join finds the one that holds the point
    cut = sources.where("high > low").select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    point = (F.col("slot").bitwiseAND((1 << POINTS) - 1) * STEP).bitwiseAND((1 << POINTS) - 1)
    slots = spark.range(n).select(F.col("id").alias("slot"), F.shiftright("id", bits).alias("run")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / width))
    slots = slots.join(cut, "cell").where("point >= low and point < high").select("slot", "run", "rank")
    slots = written(slots, "slots")
    per = slots.groupBy("rank", "run").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per.select("rank", "run", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("__b")), "before")
    nth = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("k", nth.cast("long")).join(before, ["rank", "run"]).select("slot", "rank", (F.col("k") + F.col("__b")).alias("k"))
    ranked = ranked.join(sources.select("rank", "slots"), "rank").where("k < slots").select("slot", "rank", "k")
    served = slots.groupBy("rank").agg(F.count("*").alias("c"))
    short = sources.select("rank", "slots").join(served, "rank", "left").withColumn("c", F.coalesce("c", F.lit(0))).where("c < slots")
    # a few slots a source at most, in the order of the sources
    prior = F.coalesce(F.sum(F.col("slots") - F.col("c")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = short.withColumn("prior", prior).select("rank", F.explode(F.sequence("c", F.col("slots") - 1)).alias("k"), "c", "prior")
    late = late.select((F.lit(n) + F.col("prior") + F.col("k") - F.col("c")).alias("slot"), "rank", "k")
    one = ranked.unionByName(late).join(sources.select("rank", "blocks", "source_size", "whole", "rest"), "rank")
    part = F.col("k") % F.col("blocks")
    one = one.withColumns({"pass": F.floor(F.col("k") / F.col("blocks")), "block": part})
    end = F.when(F.col("pass") < F.col("whole"), F.col("source_size")).otherwise(F.col("rest"))
    return one.select("slot", "rank", "pass", "block", F.least(F.lit(block), end - F.col("block") * block).cast("long").alias("length"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, parts).

    documents: rank, source, doc_id, size, source_size, target and start of every row of ``docs`` (doc_id, text,
    source); parts: rank, start (of the document), slot, pass, at (the word of the document) and words, what each slot
    takes. Slots in rising order are the mix.

    Null ids and sources are values like others; a null or empty text has no words and no parts, an empty table gives
    no rows. Extra columns are not read. Equal tables give equal results, however they are partitioned.
    """
    rows = sized(docs, seed)
    sources = targets(rows, weights, passes, block)
    laid = streams(rows, sources)
    each = laid.select("rank", "source", "doc_id", "size", "source_size", "target", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    each = written(each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy"), "streams")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = each.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    joined = parts.join(schedule(sources, block), ["rank", "block"])
    begin = F.greatest("start", F.col("block") * block)
    words = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("length")) - begin
    joined = joined.select("rank", "start", "slot", "pass", (begin - F.col("start")).alias("at"), words.alias("words")).where("words > 0")
    return each, joined


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; see the contract of this operator."""
    each, parts = mixed(docs)
    taken = parts.groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    some = each.where("size > 0").join(taken, ["rank", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = each.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


# The schedule decides in which order blocks are taken, not how many words of a document: whole passes, and of the last
# one the stream's words up to the target.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, k % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
             sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM w),
level AS (SELECT rest_words AS lw, rest_weight AS ww FROM o WHERE CAST(cap AS DOUBLE) * CAST(rest_weight AS DOUBLE) >= CAST(weight AS DOUBLE) * CAST(rest_words AS DOUBLE) ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(weight AS DOUBLE) * CAST(lw AS DOUBLE) / CAST(ww AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM o, level),
l AS (SELECT d.*, source_size, target, CAST('0x' || md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size)[1:8] AS BIGINT) AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CAST(floor(target + 0.5) AS BIGINT) AS take FROM l)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE take // source_size * size + greatest(0, least(size, take % source_size - start)) END AS BIGINT) AS taken FROM p
"""
