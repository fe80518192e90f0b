"""Session settings that the library relies on, and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one named by ``spark.checkpoint.dir``.

    A cluster must name one. Only where driver and tasks are one process (tests, a notebook) and the setting is
    missing, a local folder is made.
    """
    path, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
        path = _LOCAL[app]
    return f"{path.rstrip('/')}/quernstone-{app}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application.

    To be called once every result that is needed has been written: DataFrames returned before still read them.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the scratch folder and read again.

    Cuts the lineage at a table all executors can read, so a lost executor never loses it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of ``schema``, known to be none when a plan is made: joins with them fall away, and no Python runs."""
    return spark.range(1).where("false").select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
