"""Joins of a reference column with the ids that it may name, whatever share of it is null or one id.

A left join on the column alone sends all null references to one task, though they can match nothing, and all rows of a
much-used id to another. Here the join has a second key. Rows with a null reference, or with one of the ids found to be
heavy, are dealt over ``SPREAD`` values of it by a hash of the row; all others have zero there. Ids that are heavy have a
row for each value, all others one. Which ids count as heavy affects only the balance, so a sketch of bounded size finds
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 1024
HEAVY = 32  # ids at most that are dealt out
SHARE = 64  # an id is heavy if it has more than one row in so many
TRACKED = 4096  # ids that the sketch of a task follows


def heavy_ids(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The ids of each column that more than one row in SHARE has, at most HEAVY; one pass over the columns."""
    found = df.agg(F.count("*").alias("n"), *[F.expr(f"approx_top_k(`{c}`, {HEAVY}, {TRACKED})").alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return {c: [x["item"] for x in found[f"k{i}"] or [] if x["item"] is not None and x["count"] * SHARE > found.n] for i, c in enumerate(columns)}


def dealt(df: DataFrame) -> Column:
    """A number below SPREAD for each row: the same whenever its task runs again, and another for equal rows of other tasks."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(SPREAD)).cast("int")


def referenced(df: DataFrame, columns: dict[str, str], ids: DataFrame, heavy: dict[str, list] | None = None) -> DataFrame:
    """``df`` with, for each column of ``columns``, the id that it names if ``ids`` (one column) has it, else null.

    ``columns`` maps a reference column to the name of the new one. Null ids name nothing, repeated ones count once.
    """
    (key,) = ids.columns
    if heavy is None:
        heavy = heavy_ids(df, list(columns))
    once = ids.select(F.col(f"`{key}`").alias("__id")).dropna().distinct()
    out, names = df.withColumn("__lot", dealt(df)), df.columns
    for column, new in columns.items():
        many = heavy.get(column) or []
        spread = F.col(column).isNull() | F.col(column).isin(many) if many else F.col(column).isNull()
        every = F.sequence(F.lit(0), F.lit(SPREAD - 1))
        lots = F.explode(F.when(F.col("__id").isin(many), every).otherwise(F.array(F.lit(0)))) if many else F.lit(0)
        right = once.select("__id", lots.alias("__at"))
        left = out.withColumn("__at_", F.when(spread, F.col("__lot")).otherwise(0))
        out = left.join(right, (left[column] == right["__id"]) & (left["__at_"] == right["__at"]), "left").drop("__at", "__at_").withColumnRenamed("__id", new)
        names = [*names, new]
    return out.select(*[F.col(f"`{n}`") for n in names])
