"""Publication of snapshots, issue files and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import shortened

RUNS = "import_id long, source string, kind string, status string, at timestamp, fingerprint string, rows long, warnings long"


def publish(tables: dict[str, DataFrame], path: str, import_id: int) -> None:
    """Write all tables under a version of their own, then one pointer row last.

    Readers follow the pointer, so a failed write or gate leaves nothing visible. A version is never written twice:
    what is published again may read the version before, also when a lost executor's share is computed anew.
    """
    version = f"{import_id}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = spark.range(1).select(F.lit(import_id).cast("long").alias("import_id"), F.current_timestamp().alias("at"), F.lit(version).alias("version"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table of the last publication."""
    pointers = spark.read.schema("import_id long, at timestamp, version string").parquet(f"{path}/pointer")
    last = pointers.agg(F.max_by("version", F.struct("at", "import_id", "version")).alias("v")).first().v
    return spark.read.parquet(f"{path}/v={last}/{name}")


def write_issues(issues: DataFrame, path: str) -> None:
    """Issues as JSON lines; messages are cut to 80 characters."""
    issues.withColumn("message", shortened(F.col("message"))).write.mode("overwrite").json(path)


def append_run(spark: SparkSession, path: str, import_id: int, source: str, kind: str, status: str, fingerprint: str | None = None, rows: int = 0, warnings: int = 0) -> None:
    """One event of a run; the totals of a failed run are zero."""
    failed = status in ("Failed", "Cancelled")
    row = spark.range(1).select(
        F.lit(import_id).cast("long").alias("import_id"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), F.current_timestamp().alias("at"),
        F.lit(fingerprint).cast("string").alias("fingerprint"), F.lit(0 if failed else rows).cast("long").alias("rows"), F.lit(0 if failed else warnings).cast("long").alias("warnings"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def runs_of(events: DataFrame) -> DataFrame:
    """The last state of each run; at equal times an ended state counts."""
    order = F.struct("at", (F.col("status") != "Running").alias("ended"))
    rest = [c for c in events.columns if c != "import_id"]
    return events.groupBy("import_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("import_id", "r.*")


def mark_abandoned(runs: DataFrame, source: str, status: str = "Abandoned") -> DataFrame:
    """Runs of a source that were left Running get an ended status and no totals."""
    left = (F.col("source") == source) & (F.col("status") == "Running")
    return runs.withColumns({"rows": F.when(left, 0).otherwise(F.col("rows")), "status": F.when(left, status).otherwise(F.col("status"))})


def skip_if_seen(runs: DataFrame, source: str, kind: str, fingerprint: str, force: bool = False) -> bool:
    """Whether a succeeded run of the source and kind had the same fingerprint."""
    same = runs.where((F.col("source") == source) & (F.col("kind") == kind) & (F.col("status") == "Succeeded") & (F.col("fingerprint") == fingerprint))
    return not force and not same.limit(1).isEmpty()
