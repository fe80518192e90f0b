"""Fingerprints of files of any size: a tree of hashes over numbered lines, read in splits.

Every line is hashed where it is read, and only hashes move. Runs of ``FANOUT`` nodes of a file are hashed together,
level by level, until one is left, so no task holds more than that many hashes of one run, and the result depends on a
file's bytes alone, not on where Spark cuts it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.session import written

FANOUT = 1024


def line_hashes(spark: SparkSession, files: dict[str, str], parts: bool = False) -> DataFrame:
    """(role, file, size, i, h): SHA-256 of each line's bytes, with its number from 0 in its file.

    A carriage return belongs to its line, and bytes that are no UTF-8 count as they are. With ``parts`` the files of a
    role are one, in order of their paths, of which each but the last ends with a line feed; ``file`` is the role.
    """
    rows_of = None
    for role, path in files.items():
        text = spark.read.option("lineSep", "\n").text(path)
        m = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
        rows = text.select(F.lit(role).alias("role"), *[F.col(f"_metadata.{c}").alias(n) for n, c in m.items()], F.monotonically_increasing_id().alias("id"), F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("h"))
        rows_of = rows if rows_of is None else rows_of.unionByName(rows)
    hashes = written(rows_of, "line_hashes")
    per = hashes.groupBy("role", "file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("size").alias("size"))
    one = Window.partitionBy("role", *([] if parts else ["file"]))
    upto = one.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.when(F.col("block") == 0, F.col("size"))).over(one)  # the first line of a file is in its first range
    starts = per.select("role", "file", "block", size.alias("size"), (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("least")).alias("shift"))
    file = F.col("role").alias("file") if parts else F.col("file")
    return hashes.drop("size").join(starts, ["role", "file", "block"]).select("role", file, "size", (F.col("id") + F.col("shift")).alias("i"), "h")


def file_trees(spark: SparkSession, files: dict[str, str], fanout: int = FANOUT, parts: bool = False) -> DataFrame:
    """(role, file, lines, hash): of each file below a role's path, SHA-256 over its size in bytes, ``:`` and its root.

    The root is what remains of its lines' hashes when every ``fanout`` consecutive ones become the hash of their
    concatenated digits for as long as there are several. The size tells whether a last line feed is there. A file
    without a byte has no row; of a compressed file the size is the compressed one and the lines are those within.
    """
    nodes = line_hashes(spark, files, parts)
    counts = written(nodes.groupBy("role", "file").agg(F.count("*").alias("n")), "counts")
    most = counts.agg(F.max("n").alias("n")).first().n or 0
    nodes = nodes.join(F.broadcast(counts), ["role", "file"]).withColumn("lines", F.col("n")).withColumn("h", F.lower(F.hex("h")))
    while most > 1:
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda s: s["h"]), "")
        grouped = nodes.groupBy("role", "file", "size", "lines", "n", F.floor(F.col("i") / fanout).alias("run")).agg(run.alias("run_text"))
        nodes = grouped.select("role", "file", "size", "lines", F.col("run").alias("i"), F.when(F.col("n") == 1, F.col("run_text")).otherwise(F.sha2("run_text", 256)).alias("h"), F.ceil(F.col("n") / fanout).alias("n"))
        most = -(-most // fanout)
    return nodes.select("role", "file", "lines", F.sha2(F.concat(F.col("size").cast("string"), F.lit(":"), "h"), 256).alias("hash"))


def tree_hashes(spark: SparkSession, files: dict[str, str], fanout: int = FANOUT, parts: bool = False) -> DataFrame:
    """(role, lines, hash) of each role that has a byte: SHA-256 over its files' hashes, one after the other in order
    of path; a role's files are told apart by place, their names do not count. With ``parts`` a role is one file."""
    per = file_trees(spark, files, fanout, parts)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "hash"))), lambda s: s["hash"]), "")
    return per.groupBy("role").agg(F.sum("lines").alias("lines"), F.sha2(joined, 256).alias("hash"))


def tree_fingerprint(spark: SparkSession, files: dict[str, str], fanout: int = FANOUT) -> str:
    """One hash over ``role:hash`` lines in order of role, from a row a role; a role without a byte has an empty hash."""
    of = {r.role: r.hash for r in tree_hashes(spark, files, fanout).collect()}
    return hashlib.sha256("".join(f"{role}:{of.get(role, '')}\n" for role in sorted(files)).encode()).hexdigest()
