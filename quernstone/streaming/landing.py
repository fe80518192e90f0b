"""Landed revisions as a file stream into a versioned snapshot: the greatest revision wins and replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import with_normalized
from quernstone.operators.dedup import first_per_key
from quernstone.operators.snapshot import diff
from quernstone.session import written
from quernstone.sinks import buckets
from quernstone.sinks.publish import publish, published
from quernstone.sources import landed


def merge_revisions(state: DataFrame | None, batch: DataFrame, key: str, rev: str) -> DataFrame:
    """One row a key: that with the greatest revision; at equal revisions the row known before."""
    new = first_per_key(batch.dropna(subset=[key]), [key], [-F.coalesce(F.col(rev), F.lit(-1)), F.xxhash64(*batch.columns)])
    if state is None:
        return new
    both = state.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
    return first_per_key(both, [key], [-F.coalesce(F.col(rev), F.lit(-1)), F.col("__p")]).drop("__p")


def ingest_landing_stream(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, key: str, rev: str) -> None:
    """Take in all JSON files that have landed since the last call, and publish the merged snapshot.

    A batch that is run again after a failure publishes the same version again.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        # nothing is published before the first batch
        state = published(spark, target, "rows") if buckets.exists(spark, f"{target}/pointer") else None
        publish({"rows": merge_revisions(state, batch, key, rev)}, target, number)

    query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


OWN = ["taxon_name", "rank_qid", "image", "label", "title"]
ITEM = [*OWN, "last_rev_id"]
# the tables of a store of entities and the columns by which their rows are told apart
CHILDREN = {"item_name": ["qid", "language", "name"], "item_external_id": ["qid", "property", "value"]}


def merge_entities(spark: SparkSession, target: str, entities: DataFrame, import_id: int, n: int = buckets.BUCKETS, ledger: str | None = None, held: bool = False) -> buckets.Version | None:
    """Merge one batch of entity rows into the bucketed store at ``target``; None if the batch is in already.

    Of entities with one id the greatest revision counts, and only if it is not older than what the store has. Items
    are changed only where their content differs; the names and external ids of every entity that counts become exactly
    its own; an id that redirects is retired, its target stored. Missing entities change nothing. Buckets are those of
    the batch's ids, no others are read or written, and all tables change at once. Rows that are read from a written
    table (``held``) are not written again.
    """
    if ledger is not None and buckets.committed(spark, target, ledger, import_id):
        return None
    before = buckets.latest(spark, target)
    n = before.buckets if before else n
    rows = entities.where("not missing and qid is not null")
    rows = rows if held else written(rows, "entities")
    moved = rows.where("requested <> qid").select("requested")
    numbers = buckets.touched(rows.select("qid").union(moved), "qid", n)

    def current(name: str, like: DataFrame) -> DataFrame:
        return buckets.table(spark, before, name, numbers) if before and name in before.schemas else like.limit(0)

    # nulls leave no mark in the hash, so they are told apart
    content = [*OWN, *[F.col(c).isNull() for c in OWN], "names", "external_ids", "taxon_ids", F.size("taxon_ids")]
    newest = first_per_key(rows, ["qid"], [-F.coalesce(F.col("lastrevid"), F.lit(-1)), F.xxhash64(*content)])
    stamp = {"is_current": F.lit(True), "import_id": F.lit(import_id).cast("long")}
    items = current("item", landed.entity_tables(newest)["item"].withColumns(stamp))
    known = items.select(F.col("qid").alias("__q"), F.col("last_rev_id").alias("__rev"))
    # what is older than the store's revision does not count
    newest = newest.join(known, newest.qid == known["__q"], "left").where("__rev is null or lastrevid >= __rev").drop("__q", "__rev")
    tables = landed.entity_tables(written(newest, "newest"), unique=True)
    staged = tables["item"]
    tagged = diff(items, staged, ["qid"], ITEM)
    kept = F.col("new").isNull() | F.col("old").eqNullSafe(F.col("new"))
    gone = moved.select(F.col("requested").alias("__gone")).distinct()
    merged = tagged.join(gone, tagged.qid == gone["__gone"], "left")
    alive = F.coalesce("was_current", F.lit(True))
    retired = alive & F.col("__gone").isNotNull()
    merged = merged.select(
        "qid", *[F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in ITEM], (alive & ~retired).alias("is_current"),
        F.when(kept & F.col("was_current").isNotNull() & ~retired, F.col("old_import")).otherwise(F.lit(import_id)).cast("long").alias("import_id"),
    )
    out = {"item": (merged, "qid")}
    names = with_normalized(tables["item_name"], "name", "normalized")
    for name, new in (("item_name", names), ("item_external_id", tables["item_external_id"])):
        # the new rows are those of the staged entities and distinct, so only the old ones are looked at
        out[name] = current(name, new).join(staged.select("qid"), "qid", "left_anti").unionByName(new), "qid"
    return buckets.commit(spark, target, before, out, numbers, import_id, n, ledger)


def ingest_entities_stream(spark: SparkSession, source: str, target: str, checkpoint: str, n: int = buckets.BUCKETS, files_per_batch: int | None = None, batch_bytes: int = 8 << 30) -> None:
    """Take in all entity documents that have landed since the last call, in batches of files.

    A batch has files of ``batch_bytes``, or ``files_per_batch`` of them if that is given. Ids lie in all buckets, so a
    batch rewrites most of the store: batches by a number of small files would do so again and again. Each file is one document, a truncated one an error. A batch is committed together with its number and the stream's
    own id, which the checkpoint keeps, so it counts once even if it is delivered again after a failure.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        stream = own.read.text(f"{checkpoint}/metadata").first()[0]
        documents = batch.select(F.from_json("value", landed.ENTITIES, {"mode": "FAILFAST"}).alias("d")).select("d.entities")
        merge_entities(own, target, landed.entity_rows(documents), number, n, stream)

    most = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", str(batch_bytes))
    documents = spark.readStream.option("wholetext", True).option(*most).text(source)
    query = documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
