"""Tables in key buckets with copy-on-write versions: a change rewrites the buckets that it touches and nothing else.

A folder holds several tables whose rows are dealt by a hash of their keys into the same number of buckets. A version is
a manifest: for each table and bucket the folder with its rows, from whichever version wrote it last. A commit writes the
touched buckets under a name of its own, then the manifest, and the pointer last, so readers see all tables change at
once, readers of an older version still find its files, and a failed write leaves nothing visible. A pointer may name
the batch of a stream that it commits; that batch is then known to be in, however often it is delivered.

Manifests have as many rows as tables have buckets, a parameter; the driver reads them whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.snapshot import change_only_upsert, diff

POINTERS = "import_id long, at timestamp, version string, ledger string"
MANIFEST = "table string, bucket int, folder string, rows long, schema string"
BUCKETS = 256
BUCKET = "__bucket"


@dataclass
class Version:
    path: str
    name: str
    buckets: int
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    rows: dict[str, dict[int, int]] = field(default_factory=dict)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def bucket_of(key: Column, n: int) -> Column:
    """The bucket of a key; all null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def touched(rows: DataFrame, key: str, n: int) -> list[int]:
    """The buckets of the keys of ``rows``, at most ``n``."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col(key), n).alias(BUCKET)).distinct().collect())


def latest(spark: SparkSession, path: str) -> Version | None:
    """The version that the last pointer names, or None before the first commit."""
    if not exists(spark, f"{path}/pointer"):
        return None
    last = spark.read.schema(POINTERS).parquet(f"{path}/pointer").agg(F.max_by("version", F.struct("at", "import_id", "version")).alias("v")).first().v
    return version(spark, path, last)


def version(spark: SparkSession, path: str, name: str) -> Version:
    """A version by its name; old ones stay readable."""
    out = Version(path, name, int(name.split("-")[1]))
    for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={name}").collect():
        out.schemas[r.table] = T.StructType.fromJson(json.loads(r.schema))
        if r.bucket is not None:
            out.folders.setdefault(r.table, {})[r.bucket] = r.folder
            out.rows.setdefault(r.table, {})[r.bucket] = r.rows
    return out


def table(spark: SparkSession, at: Version, name: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table, or of some of its buckets; files of other buckets are not opened."""
    own = at.folders.get(name, {})
    folders = [f"{at.path}/{own[b]}" for b in (sorted(own) if buckets is None else buckets) if b in own]
    return spark.read.schema(at.schemas[name]).parquet(*folders) if folders else spark.createDataFrame([], at.schemas[name])


def committed(spark: SparkSession, path: str, ledger: str, import_id: int) -> bool:
    """Whether a batch of a stream is in already."""
    if not exists(spark, f"{path}/pointer"):
        return False
    rows = spark.read.schema(POINTERS).parquet(f"{path}/pointer")
    return not rows.where((F.col("ledger") == ledger) & (F.col("import_id") == import_id)).limit(1).isEmpty()


def commit(spark: SparkSession, path: str, before: Version | None, rows: dict[str, tuple[DataFrame, str]], buckets: list[int], import_id: int, n: int = BUCKETS, ledger: str | None = None) -> Version:
    """Publish a version in which ``buckets`` of each table hold exactly ``rows`` (table to rows and key column).

    ``rows`` may be read from ``before``, whose files stay as they are. Tables that are not named, and other buckets,
    keep their files. Rows that fall into other buckets are a mistake of the caller and not written.
    """
    n = before.buckets if before else n
    name = f"{import_id}-{n}-{uuid.uuid4().hex}"
    after = Version(path, name, n, {t: dict(f) for t, f in before.folders.items()} if before else {}, dict(before.schemas) if before else {}, {t: dict(f) for t, f in before.rows.items()} if before else {})
    folder = f"data/v={name}"
    for t, (df, key) in rows.items():
        after.schemas[t] = df.schema
        after.folders.setdefault(t, {})
        after.rows.setdefault(t, {})
        if buckets:
            # a task a bucket: hashed once more, some tasks would have several and others none
            at = {b: i for i, b in enumerate(buckets)}
            place = F.array(*[F.lit(at.get(b, 0)) for b in range(n)])
            dealt = df.withColumn(BUCKET, bucket_of(F.col(key), n)).where(F.col(BUCKET).isin(buckets))
            dealt.repartitionById(len(buckets), place[F.col(BUCKET)]).write.partitionBy(BUCKET).parquet(f"{path}/{folder}/{t}")
    if buckets and rows:
        counts = None
        for t, (df, _) in rows.items():
            schema = T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])
            own = spark.read.schema(schema).parquet(f"{path}/{folder}/{t}").groupBy(BUCKET).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), BUCKET, "n")
            counts = own if counts is None else counts.unionAll(own)
        made = {(r.t, r[BUCKET]): r.n for r in counts.collect()}
        for t in rows:
            for b in buckets:
                after.folders[t].pop(b, None)
                after.rows[t].pop(b, None)
                if (t, b) in made:
                    after.folders[t][b], after.rows[t][b] = f"{folder}/{t}/{BUCKET}={b}", made[t, b]
    listed = [(t, b, f, after.rows[t][b], after.schemas[t].json()) for t, of in after.folders.items() for b, f in of.items()]
    listed += [(t, None, None, 0, s.json()) for t, s in after.schemas.items() if not after.folders.get(t)]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/v={name}")
    row = spark.range(1).select(F.lit(import_id).cast("long").alias("import_id"), F.current_timestamp().alias("at"), F.lit(name).alias("version"), F.lit(ledger).cast("string").alias("ledger"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return after


def publish_changes(spark: SparkSession, path: str, name: str, stage: DataFrame, key: str, cols: list[str], import_id: int, n: int = BUCKETS, policy: Callable = change_only_upsert) -> Version:
    """Bring a table up to ``stage`` by a policy over tagged rows, and rewrite only buckets in which a row changes.

    The comparison reads both tables once and sends at most ``n`` bucket numbers to the driver; the buckets that change
    are then read, merged and written by themselves. The table keeps ``cols``, is_current and import_id. A policy that
    stamps every row touches every bucket.
    """
    before = latest(spark, path)
    n = before.buckets if before else n
    if before and name in before.schemas:
        current = table(spark, before, name)
    else:
        current = stage.select(key, *cols).limit(0).withColumns({"is_current": F.lit(True), "import_id": F.lit(0).cast("long")})
    changed = touched(diff(current, stage, [key], cols).where("action <> 'same'"), key, n)
    if before and name in before.schemas:
        current = table(spark, before, name, changed)
    part = stage.where(bucket_of(F.col(key), n).isin(changed)) if changed else stage.limit(0)
    merged = policy(current, part, [key], cols, import_id)
    return commit(spark, path, before, {name: (merged, key)}, changed, import_id, n)
