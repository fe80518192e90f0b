"""Snapshots: one comparison of the current table with a new stage, and the policies over it.

``diff`` full-outer-joins the two on the natural key, null-safe, and tags each row with one action. All other
functions read the tagged rows; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ["insert", "update", "reactivate", "retire", "delete", "same"]


def diff(current: DataFrame, stage: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key, old, new, action). ``current`` may have is_current; rows without it all count as current.

    insert: only staged; update: content differs; reactivate: was retired; retire: current and not staged;
    same: nothing differs, or retired and still absent.
    """
    alive = F.col("is_current") if "is_current" in current.columns else F.lit(True)
    stamp = F.col("import_id") if "import_id" in current.columns else F.lit(None).cast("long")
    c = current.select(*[F.col(k).alias(f"__c_{k}") for k in key], F.struct(*cols).alias("old"), alive.alias("was_current"), stamp.alias("old_import"))
    s = stage.select(*[F.col(k).alias(f"__s_{k}") for k in key], F.struct(*cols).alias("new"))
    on = None
    for k in key:
        same = F.col(f"__c_{k}").eqNullSafe(F.col(f"__s_{k}"))
        on = same if on is None else on & same
    rows = c.join(s, on, "full")
    action = (
        F.when(F.col("was_current").isNull(), "insert")
        .when(F.col("new").isNull(), F.when(F.col("was_current"), "retire").otherwise("same"))
        .when(~F.col("was_current"), "reactivate")
        .when(~F.col("old").eqNullSafe(F.col("new")), "update")
        .otherwise("same")
    )
    ids = [F.when(F.col("new").isNotNull(), F.col(f"__s_{k}")).otherwise(F.col(f"__c_{k}")).alias(k) for k in key]
    return rows.select(*ids, "old", "new", "was_current", "old_import", action.alias("action"))


def counts(tagged: DataFrame) -> DataFrame:
    """(action, n) of each action that occurs."""
    return tagged.groupBy("action").agg(F.count("*").alias("n"))


def snapshot_upsert(current: DataFrame, stage: DataFrame, key: list[str], cols: list[str], import_id: int, clear_on_retire: list[str] | None = None, stamp_retired: bool = False) -> DataFrame:
    """Every staged row becomes current with ``import_id``; absent rows stay as retired, some columns cleared."""
    rows = diff(current, stage, key, cols)
    staged = F.col("new").isNotNull()
    cleared = set(clear_on_retire or [])

    def value(c: str) -> Column:
        old = F.when(F.col("action") != "retire", F.col(f"old.{c}")) if c in cleared else F.col(f"old.{c}")
        return F.when(staged, F.col(f"new.{c}")).otherwise(old).alias(c)

    kept = F.when((F.col("action") == "retire") & F.lit(stamp_retired), F.lit(import_id)).otherwise(F.col("old_import"))
    return rows.select(*key, *[value(c) for c in cols], staged.alias("is_current"), F.when(staged, F.lit(import_id)).otherwise(kept).cast("long").alias("import_id"))


def change_only_upsert(current: DataFrame, stage: DataFrame, key: list[str], cols: list[str], import_id: int) -> DataFrame:
    """As an upsert, but rows that do not change keep their import_id; retiring stamps it."""
    rows = diff(current, stage, key, cols)
    staged = F.col("new").isNotNull()
    touched = F.col("action") != "same"
    return rows.select(
        *key,
        *[F.when(staged, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in cols],
        staged.alias("is_current"),
        F.when(touched, F.lit(import_id)).otherwise(F.col("old_import")).cast("long").alias("import_id"),
    )


def mirror_seed(current: DataFrame, seed: DataFrame, key: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table equal to the seed, and counts of insert, update, delete and same."""
    rows = diff(current.drop("is_current"), seed, key, cols)
    return seed, counts(rows.withColumn("action", F.when(F.col("action") == "retire", "delete").otherwise(F.col("action"))))


def replace_all(new: DataFrame, key: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The new rows with one row a key, and how many came in and were collapsed."""
    from quernstone.operators.dedup import first_per_key

    kept = first_per_key(new, key, order)
    total = new.agg(F.count("*").alias("rows_in")).crossJoin(kept.agg(F.count("*").alias("rows_kept")))
    return kept, total.select("rows_in", "rows_kept", (F.col("rows_in") - F.col("rows_kept")).alias("collapsed"))


def replace_children(current: DataFrame, new: DataFrame, fetched: DataFrame, parent: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Children of fetched parents become exactly the new ones; those of other parents stay. Also insert and delete counts."""
    parents = fetched.select(*parent).distinct()
    others = current.join(parents, parent, "left_anti")
    mine = new.join(parents, parent, "left_semi").dropDuplicates(key)
    before = current.join(parents, parent, "left_semi")
    tagged = mine.select(*key).join(before.select(*key), key, "left_anti").select(F.lit("insert").alias("action"))
    gone = before.select(*key).join(mine.select(*key), key, "left_anti").select(F.lit("delete").alias("action"))
    return others.unionByName(mine), counts(tagged.unionAll(gone))


def apply_redirects(items: DataFrame, redirects: DataFrame, key: str = "qid") -> DataFrame:
    """Items whose id redirects are retired; a row for the target is added where it is missing.

    ``redirects`` has requested and actual ids.
    """
    moved = redirects.where("requested <> actual").select(F.col("requested").alias(key), F.col("actual").alias("__to")).dropDuplicates([key])
    rows = items.join(moved, key, "left")
    kept = rows.withColumn("is_current", F.col("is_current") & F.col("__to").isNull())
    targets = rows.where(F.col("__to").isNotNull()).withColumn(key, F.col("__to")).join(items.select(key), key, "left_anti").dropDuplicates([key])
    return kept.drop("__to").unionByName(targets.withColumn("is_current", F.lit(True)).drop("__to").select(*items.columns))


def set_mismatch(left: DataFrame, right: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups whose sets of values differ between the two tables."""
    cols = [*group, value]
    a, b = left.select(*cols).distinct().withColumn("__l", F.lit(1)), right.select(*cols).distinct().withColumn("__r", F.lit(1))
    return a.join(b, cols, "full").where("__l is null or __r is null").select(*group).distinct()


def needs_refresh(state: DataFrame, info: DataFrame, key: str, full: bool = False) -> DataFrame:
    """Keys to fetch again: never fetched, redirected, of another revision, or all if ``full``; never missing ones.

    ``state`` has fetched_rev, null for what was never fetched; ``info`` has rev, missing and redirected, for articles
    disambiguation as well, which is never fetched. A key without information is due if it was never fetched.
    """
    told = info.withColumn("__told", F.lit(True))
    rows = told.join(state.select(key, "fetched_rev"), key, "full")
    for flag in ("missing", "disambiguation"):
        if flag in info.columns:
            rows = rows.where(~F.coalesce(flag, F.lit(False)))
    moved = F.coalesce("redirected", F.lit(False)) if "redirected" in info.columns else F.lit(False)
    changed = F.col("__told").isNotNull() & (moved | ~F.col("rev").eqNullSafe(F.col("fetched_rev")))
    return rows.where(F.lit(full) | F.col("fetched_rev").isNull() | changed).select(key, "rev", "fetched_rev")


def retire_links(links: DataFrame, outcomes: DataFrame, key: str, cols: list[str], import_id: int) -> DataFrame:
    """Links equal to the outcomes: those of retired keys go, unchanged ones keep their import_id."""
    out = change_only_upsert(links, outcomes, [key], cols, import_id)
    return out.where("is_current").drop("is_current")
