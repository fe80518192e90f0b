"""First row of each key, dictionary encoding, top rows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``, which must be total.

    An aggregate, so each task sends one row a key; hot keys are reduced before they move.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__r"))
    return ranked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def dictionary_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the SHA-256 of each text instead of it, and the distinct texts that they use."""
    coded = df.select(*[F.sha2(F.col(c).cast("binary"), 256).alias(c) if c in cols else F.col(c) for c in df.columns])
    texts = df.select(F.explode(F.array(*cols)).alias("text")).where("text is not null")
    return coded, texts.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.first("text").alias("text"))


def ranked_page(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only that many a group and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def deterministic_sample(df: DataFrame, key: str, n: int, seed: int, always: DataFrame | None = None) -> DataFrame:
    """The distinct keys of a seeded sample of ``n``, those with the smallest MD5 of seed and key, and those of ``always``."""
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    some = df.select(key).distinct().orderBy(lot, key).limit(n)
    return some if always is None else some.union(always.select(key)).distinct()


def limit_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.select(key).distinct().orderBy(key).limit(n)
