"""A stored index of the pieces of names, so that a search reads what its queries' rarest pieces point at.

The index holds the rows of searchable texts, and postings: for each field (scientific name and genus, common name, its
compact form) and each distinct piece of one, two or three characters the texts that have it. Rows of one text share
its number, a hash of the text, and its postings are written once. Field and piece are a hash as well, which is all
that moves and is sorted. Texts are tried for the query itself at the end, so hashes that meet cost time and add or
lose nothing. Postings and the numbers of texts a piece has are dealt into buckets by the piece's hash, a folder each.
A query looks up the numbers of its pieces (three characters, or the whole query if it is shorter), takes the rarest,
reads only the buckets of these, and tries the texts that they name. It is the same for any number of queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.search import MATCH, PAGE, checked, common_texts, common_tier, grams, pages, queries_of, scientific_texts, scientific_tier
from quernstone.session import written

BUCKETS = 64
PARTS = 8  # of the rows of one text and of the texts of one piece
SIZES = (1, 2, 3)


def code_of(field: Column, gram: Column) -> Column:
    return F.xxhash64(field, gram)


def bucket(code: Column, n: int) -> Column:
    return F.pmod(code, F.lit(n)).cast("int")


def build_index(taxa: DataFrame, names: DataFrame, item_links: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of the current names under ``path``, which must be new.

    A text is a row a distinct piece, so postings are linear in the lengths of the distinct texts; a piece that many
    texts have is spread over PARTS parts of its bucket, and a folder may have several files.
    """
    spark = taxa.sparkSession
    s = scientific_texts(taxa).select("target", "matched_on", "source_order", "matched_text", F.lower("both").alias("hay"), F.lit(None).cast("string").alias("normalized"), F.lit(None).cast("string").alias("compact"))
    c = common_texts(names, item_links).select("target", F.lit("commonName").alias("matched_on"), F.lit(2).alias("source_order"), "matched_text", F.lit(None).cast("string").alias("hay"), "normalized", "compact")
    # nulls leave no mark in a hash, so the fields that a row has are told apart
    ids = F.xxhash64("hay", "normalized", "compact", F.col("hay").isNull(), F.col("normalized").isNull())
    # few bytes of a table are many rows, so they are dealt before they are worked on, and tasks are not coalesced
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s.unionByName(c).repartition(n, "target", "matched_text").withColumn("text_id", ids).write.parquet(f"{path}/texts")
    # texts whose numbers meet stay apart here, so each has all its pieces
    texts = spark.read.parquet(f"{path}/texts").select("text_id", "hay", "normalized", "compact").distinct()
    texts = texts.repartition(n, "text_id")

    def codes(field: str, column: str) -> Column:
        every = F.flatten(F.array(*[grams(F.col(column), k) for k in SIZES]))
        return F.when(F.col(column).isNotNull(), F.transform(every, lambda g: code_of(F.lit(field), g)))

    every = F.array_compact(F.array(codes("s", "hay"), codes("n", "normalized"), codes("c", "compact")))
    postings = texts.select("text_id", F.explode(F.flatten(every)).alias("code")).withColumn("bucket", bucket(F.col("code"), buckets))
    # by piece and a part of the texts: a piece in every text does not make one task do its bucket alone
    postings.repartition(F.col("bucket"), F.pmod(F.col("text_id"), F.lit(PARTS))).write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "code").agg(F.count("*").alias("df"))
    counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")


def in_buckets(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` without the buckets that ``rows`` do not need; there are at most as many numbers as buckets."""
    return table.where(F.col("bucket").isin([r.bucket for r in rows.select("bucket").distinct().collect()]))


def candidates(spark: SparkSession, path: str, q: DataFrame) -> DataFrame:
    """(query, field, needle, text_id): for each query and field the texts that have its rarest piece."""
    n = spark.read.parquet(f"{path}/meta").first().buckets
    compact = F.nullif(F.col("cq"), F.lit(""))
    # without a normalised form a query has no business with common names
    needles = [F.struct(F.lit("s").alias("field"), F.lower("query").alias("needle"))]
    needles += [F.struct(F.lit(f).alias("field"), F.when(F.col("nq") != "", v).alias("needle")) for f, v in (("n", F.col("nq")), ("c", compact))]
    wanted = q.select("query", F.inline(F.array(*needles))).where("needle is not null")
    size = F.least(F.length("needle"), F.lit(max(SIZES)))
    pieces = F.when(size == 1, grams(F.col("needle"), 1)).when(size == 2, grams(F.col("needle"), 2)).otherwise(grams(F.col("needle"), 3))
    pieces = wanted.select("query", "field", "needle", F.explode(pieces).alias("gram")).withColumn("code", code_of(F.col("field"), F.col("gram"))).withColumn("bucket", bucket(F.col("code"), n))
    pieces = written(pieces, "pieces")
    counts = in_buckets(spark.read.parquet(f"{path}/counts"), pieces)
    known = pieces.join(counts, ["bucket", "code"], "left")
    # a piece that no text has finds nothing
    rare = known.groupBy("query", "field", "needle").agg(F.min_by(F.struct("bucket", "code"), F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("g")).select("query", "field", "needle", "g.*")
    rare = written(rare, "rare")
    return in_buckets(spark.read.parquet(f"{path}/postings"), rare).join(rare, ["bucket", "code"]).select("query", "field", "needle", "text_id").distinct()


def search_index(spark: SparkSession, path: str, taxa: DataFrame, names: DataFrame, item_links: DataFrame, queries: DataFrame, page_size: int = PAGE) -> DataFrame:
    """As ``search_names``, by the index that :func:`build_index` has written from the same tables."""
    checked(page_size)
    q = written(queries_of(queries), "queries")
    # many rows may share a text: they are dealt over parts, each of which has the text's queries
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.read.parquet(f"{path}/texts").withColumn("part", F.pmod(F.xxhash64("target"), F.lit(PARTS))).repartition(n, "text_id", "part")
    asked = candidates(spark, path, q).withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))
    found = asked.repartition(n, "text_id", "part").hint("merge").join(rows, ["text_id", "part"])
    text = F.when(F.col("field") == "s", F.col("hay")).when(F.col("field") == "n", F.col("normalized")).otherwise(F.col("compact"))
    found = found.where(F.contains(text, F.col("needle"))).join(q, "query").withColumn("cq", F.nullif(F.col("cq"), F.lit("")))
    return pages(found.withColumn("tier", F.when(F.col("field") == "s", scientific_tier()).otherwise(common_tier())).select(*MATCH), q, taxa, names, item_links, page_size)
