"""Row validation with a side table of issues, rule tables and publication gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import is_blank, shortened


def issue(severity: str, kind: str, field: str, when: Column, value: Column | None = None) -> Column:
    return F.when(
        when,
        F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.lit(field).alias("field"), shortened(F.coalesce(value, F.lit("")) if value is not None else F.lit("")).alias("message")),
    )


def split_valid(df: DataFrame, required: list[str], identifiers: list[str], file: str, key: str | None = None, extra: list[Column] | None = None, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows and the issues of all rows.

    A blank required value or a NUL rejects the row; U+FFFD rejects it in an identifier and only warns elsewhere.
    A rejected row keeps all its issues. ``row`` names a column with the record's number, which issues then have as
    well. Issues are made in the pass that reads the rows.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    found = list(extra or [])
    found += [issue("error", "required", c, is_blank(F.col(c))) for c in required]
    for c in texts:
        found.append(issue("error", "nul", c, F.contains(F.col(c), F.lit("\x00"))))
        found.append(issue("error" if c in identifiers else "warning", "replacement_character", c, F.contains(F.col(c), F.lit("�"))))
    marked = df.withColumn("__issues", F.filter(F.array(*found), lambda i: i.isNotNull()))
    good = marked.where(~F.exists("__issues", lambda i: i.severity == "error")).drop("__issues")
    key_col = F.col(key).cast("string") if key else F.lit(None).cast("string")
    issues = marked.where(F.size("__issues") > 0).select(F.lit(file).alias("file"), key_col.alias("key"), *([F.col(row).alias("row")] if row else []), F.inline("__issues"))
    return good, issues


def check_rules(df: DataFrame, rules: dict[str, Column], example: Column, limit: int = 20) -> DataFrame:
    """(rule, failures, examples): rows that break each rule, with the first examples in order; one pass."""
    broken = F.explode(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull()))
    return count_with_examples(df.select(broken.alias("rule"), example.alias("example")), ["rule"], F.col("example"), limit).withColumnRenamed("n", "failures")


def count_with_examples(df: DataFrame, keys: list[str], example: Column, limit: int = 20) -> DataFrame:
    """(keys, n, examples): a count and the ``limit`` smallest distinct examples of each group.

    Distinct examples are ranked first, so no group is ever collected beyond its limit.
    """
    from pyspark.sql import Window

    counted = df.groupBy(*keys, example.cast("string").alias("__e")).agg(F.count("*").alias("__n"))
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__e"))
    top = counted.withColumn("__r", rank).where(F.col("__r") <= limit)
    top = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__e")), "|").alias("examples"))
    return totals.join(top, keys)


def count_unstored(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n): non-empty values of each column that will not be stored."""
    row = df.agg(*[F.count_if(F.length(c) > 0).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "n")


class GateClosed(ValueError):
    """Publication was refused."""


def gate(metrics: DataFrame, conditions: dict[str, str]) -> dict:
    """The one row of ``metrics``, if every SQL condition over it holds."""
    row = metrics.select("*", *[F.expr(c).alias(f"__{n}") for n, c in conditions.items()]).first().asDict()
    closed = [n for n in conditions if not row[f"__{n}"]]
    if closed:
        raise GateClosed(", ".join(closed))
    return {k: v for k, v in row.items() if not k.startswith("__")}


def shrink_guard(new_count: int, current_count: int, allow: bool = False) -> None:
    """Refuse an empty snapshot, and one that loses more than half of the rows unless that is allowed."""
    if new_count == 0 or (new_count * 2 < current_count and not allow):
        raise GateClosed(f"{new_count} rows after {current_count}")
