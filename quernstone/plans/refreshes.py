"""Imports of landed details and articles: what is due by revision is taken over, everything else is left as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import article_url, is_requestable_title
from quernstone.operators import profile
from quernstone.operators.articles import apply_article_updates, select_titles, title_link_counts
from quernstone.operators.dedup import first_per_key
from quernstone.operators.snapshot import diff, needs_refresh, set_mismatch
from quernstone.session import empty, written
from quernstone.sinks import buckets
from quernstone.sinks.publish import publish, published
from quernstone.sources import landed
from quernstone.streaming.landing import CHILDREN, ITEM, merge_entities

ISSUE = ("severity", "kind", "key", "message")


def warnings(rows: DataFrame, kind: str, key: str, message: str) -> DataFrame:
    """One warning a row, with the place of {} in ``message`` taken by the key."""
    before, after = message.split("{}")
    return rows.select(F.lit("warning").alias("severity"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.concat(F.lit(before), F.coalesce(key, F.lit("")), F.lit(after)).alias("message"))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def metrics(of: list[DataFrame]) -> DataFrame:
    """(metric, n) from frames of one row of numbers each."""
    return together([df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("m")).select("m.*") for df in of])


def _stored(spark: SparkSession, at: buckets.Version | None, name: str, like: DataFrame, only: list[int] | None = None) -> DataFrame:
    return buckets.table(spark, at, name, only) if at and name in at.schemas else like.limit(0)


def store_changes(spark: SparkSession, before: buckets.Version | None, after: buckets.Version) -> list[DataFrame]:
    """Counts of what differs between two versions of an entity store; only buckets whose files differ are read."""

    def sides(name: str) -> tuple[DataFrame, DataFrame]:
        was, now = before.folders.get(name, {}) if before else {}, after.folders.get(name, {})
        differ = sorted(b for b in was.keys() | now.keys() if was.get(b) != now.get(b))
        new = buckets.table(spark, after, name, differ)
        return _stored(spark, before, name, new, differ), new

    old, new = (side.select("qid", *ITEM, F.col("is_current").alias("alive")) for side in sides("item"))
    rows = diff(old, new, ["qid"], [*ITEM, "alive"])
    content = [F.struct(*[F.col(f"{side}.{c}") for c in ITEM]) for side in ("old", "new")]
    out = [rows.agg(
        F.count_if(F.col("action") == "insert").alias("items_inserted"), F.count_if((F.col("action") == "update") & ~content[0].eqNullSafe(content[1])).alias("items_updated"),
        F.count_if((F.col("action") != "insert") & F.col("old.alive") & ~F.col("new.alive")).alias("items_retired"),
    )]
    for name, label in (("item_name", "names"), ("item_external_id", "external_ids")):
        old, new = sides(name)
        key = CHILDREN[name]
        tagged = diff(old.select(*key), new.select(*key), key, key)
        out.append(tagged.agg(F.count_if(F.col("action") == "insert").alias(f"{label}_inserted"), F.count_if(F.col("action") == "retire").alias(f"{label}_deleted")))
    return out


def import_details(spark: SparkSession, path: str, target: str, wanted: DataFrame, links: DataFrame, import_id: int, full: bool = False, batches: int = 1, n: int = buckets.BUCKETS) -> dict[str, DataFrame]:
    """Bring the entity store at ``target`` up to the landed entities at ``path``; returns report and issues.

    Asked for are the ids in ``wanted`` (qid) and the store's current ones. Of these, entities count that were never
    stored, redirect, or have another revision, and all with ``full``; other entities are left alone. Missing ones keep
    what is stored, ids that redirect are retired and their targets stored. ``links`` (qid, taxon_id_raw, may have
    is_current) stay authoritative: an entity whose own taxon ids differ from them is reported only.

    The ids are dealt into ``batches`` by their buckets, each committed by itself; a run that broke off leaves the
    committed ones, and the next run finds their revisions and passes over them. Null ids count for nothing; of several
    landed rows of an id that with the greatest revision tells whether it is due. Without any landed entity nothing
    changes. The report is by run: what an earlier run committed is not in it.
    """
    start = buckets.latest(spark, target)
    n = start.buckets if start else n
    rows = written(landed.entity_rows(spark.read.schema(landed.ENTITIES).json(path, multiLine=True, mode="FAILFAST")), "entities")
    stored = _stored(spark, start, "item", empty(spark, "qid string, last_rev_id long, is_current boolean"))
    asked = written(wanted.select("qid").union(stored.where("is_current").select("qid")).dropna().distinct(), "asked")
    told = first_per_key(rows.where("requested is not null").select("requested", "qid", "missing", "lastrevid"), ["requested"], [-F.coalesce(F.col("lastrevid"), F.lit(-1)), F.col("qid")])
    info = told.select(F.col("requested").alias("qid"), F.col("lastrevid").alias("rev"), "missing", F.coalesce(F.col("qid") != F.col("requested"), F.lit(False)).alias("redirected"), F.col("qid").alias("actual"))
    info = written(info.join(asked, "qid", "left_semi"), "info")
    due = needs_refresh(stored.select("qid", F.col("last_rev_id").alias("fetched_rev")).join(asked, "qid", "left_semi"), info, "qid", full)
    chosen = written(rows.where("not missing").join(due.select(F.col("qid").alias("requested")), "requested", "left_semi"), "due")
    for i in range(batches):
        part = chosen.where(F.pmod(buckets.bucket_of(F.col("requested"), n), F.lit(batches)) == i)
        if not part.isEmpty():
            merge_entities(spark, target, part, import_id, n, None, True)

    tables = landed.entity_tables(chosen)
    fetched = tables["item"].select("qid").distinct()
    live = links.where("is_current") if "is_current" in links.columns else links
    mismatch = written(set_mismatch(tables["item_taxon_id"], live.join(fetched, "qid", "left_semi"), ["qid"], "taxon_id_raw"), "mismatch")
    moved = info.where("redirected and not missing").join(chosen.select(F.col("requested").alias("qid")), "qid", "left_semi")
    issues = together([
        warnings(info.where("missing"), "missing", "qid", "Entity {} is missing; its stored details were kept."),
        warnings(moved, "redirect", "qid", "Entity {} redirects; it is retired and its details are stored under the target."),
        warnings(asked.join(info, "qid", "left_anti"), "absent", "qid", "No entry came for {}; it was left unchanged."),
        warnings(mismatch, "taxon_ids", "qid", "Taxon ids of {} differ from its links; the links are kept."),
        tables["issues"].select("severity", "kind", F.col("message").alias("key"), "message"),
    ])
    counted = [
        asked.agg(F.count("*").alias("items_checked")), info.agg(F.count_if("missing").alias("items_missing")), moved.agg(F.count("*").alias("items_redirected")),
        chosen.agg(F.countDistinct("requested").alias("items_fetched")), mismatch.agg(F.count("*").alias("taxon_id_mismatches")),
    ]
    after = buckets.latest(spark, target)
    report = metrics([*counted, *(store_changes(spark, start, after) if after else [])])
    publish({"report": report, "issues": issues}, f"{target}/runs", import_id)
    return {name: published(spark, f"{target}/runs", name) for name in ("report", "issues")}


META = ["page_title", "page_id", "item", "short_description", "url"]
CONTENT = [*META, "lead", "rev", "status"]
ARTICLE = """title string, page_title string, page_id long, item string, short_description string, url string, lead string, rev long,
status string, fetched_at timestamp, is_current boolean, import_id long"""


def import_articles(spark: SparkSession, info_path: str, lead_path: str, items: DataFrame, current: DataFrame | None, links: DataFrame | None, target: str, import_id: int, full: bool = False) -> dict[str, DataFrame]:
    """Select the articles of ``items`` (qid, title, is_current), refresh those that are due, and publish them.

    ``current`` and ``links`` are article and article_link of the import before. Page information of all current titles
    is landed at ``info_path``, pages with their leads at ``lead_path``. A lead is taken over if the article has none
    yet, if its revision is another one, or with ``full``. Titles that cannot be requested, pages that do not exist or
    are in no response, and pages that are gone from the leads' responses are Missing and keep what is stored. Rows of
    which nothing changes keep their import_id, and their time of fetching too; retired articles keep their text.
    """
    nothing = empty(spark, ARTICLE)
    before = nothing if current is None else current.select(*nothing.columns)
    known = before.select("title", "status", "is_current", "import_id")
    selected, pairs = select_titles(items, known, import_id)
    pairs = written(pairs, "pairs")
    rest = before.drop("status", "is_current", "import_id")
    articles = written(selected.join(rest, "title", "left").select(*before.columns), "articles")
    live = articles.where("is_current")

    usable = F.coalesce(is_requestable_title(F.col("title")), F.lit(False))
    info = landed.scan_pages_json(spark, info_path, live.where(usable).select("title")).withColumn("asked", F.lit(True))
    barred = live.where(~usable).select(F.col("title").alias("requested_title"), F.lit(True).alias("missing"), F.lit(False).alias("asked"))
    info = written(info.unionByName(barred, allowMissingColumns=True).withColumnRenamed("title", "page_title").withColumnRenamed("requested_title", "title"), "info")
    state = live.select("title", F.when(F.col("fetched_at").isNotNull(), F.col("rev")).alias("fetched_rev"))
    due = needs_refresh(state, info.select("title", "rev", "missing", "disambiguation"), "title", full).select("title")
    pages = landed.scan_pages_json(spark, lead_path, due).select(F.col("requested_title").alias("title"), F.col("missing").alias("vanished"), F.col("rev").alias("lead_rev"), F.col("extract").alias("lead"))
    pages = written(pages, "leads")
    gone = F.col("missing") | F.coalesce("vanished", F.lit(False))
    info = written(info.join(pages.select("title", "vanished"), "title", "left").withColumn("missing", gone), "told")

    fresh = pages.where("not vanished").select("title", "lead", F.col("lead_rev").alias("rev"), F.current_timestamp().alias("fetched_at"))
    # of the items that name a title only the one that its page names matters, so no list of them is made
    requesting = pairs.join(info.select("title", F.col("item").alias("qid")), ["title", "qid"], "left_semi").select("title", F.array("qid").alias("qids"))
    updates = apply_article_updates(live.select("title", "status", "lead", "rev", "fetched_at"), info.select("title", "missing", "disambiguation", "item", "rev"), fresh, requesting)
    updates = updates.select("title", *[F.col(c).alias(f"new_{c}") for c in ("status", "lead", "rev", "fetched_at")])
    meta = info.select("title", "missing", "page_title", "page_id", "item", "short_description", article_url(F.col("page_title")).alias("url"))
    meta = meta.select("title", F.col("missing").alias("__gone"), *[F.col(c).alias(f"new_{c}") for c in META])
    rows = articles.join(updates, "title", "left").join(meta, "title", "left")
    for c in META:
        rows = rows.withColumn(f"new_{c}", F.when(F.col("__gone"), F.col(c)).otherwise(F.col(f"new_{c}")))
    told = F.col("__gone").isNotNull()
    old, new = (F.struct(*[F.col(p + c).alias(c) for c in CONTENT], F.col(f"{p}fetched_at").isNull().alias("none")) for p in ("", "new_"))
    rows = written(rows.withColumn("__changed", told & ~old.eqNullSafe(new)), "refreshed")
    changed = F.col("__changed")
    article = rows.select(*[
        F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in (*CONTENT, "fetched_at") else F.when(changed, F.lit(import_id)).otherwise(F.col(c)).cast("long").alias(c) if c == "import_id" else F.col(c)
        for c in before.columns
    ])

    was = known.select("title", F.col("is_current").alias("was"))
    turned = articles.select("title", "is_current").join(was, "title", "left")
    issues = warnings(info.where("not asked"), "title", "title", "Title {} cannot be requested; it is treated as missing.")
    issues = issues.unionByName(warnings(info.where("missing"), "missing", "title", "Page {} does not exist; any stored lead was kept."))
    no_links = empty(spark, "qid string, title string")
    inserted = title_link_counts(pairs, no_links if links is None else links)
    report = metrics([
        turned.agg(
            F.count_if("is_current").alias("titles_selected"), F.count_if(F.col("was").isNull()).alias("articles_inserted"),
            F.count_if(F.col("is_current") & ~F.col("was")).alias("articles_reactivated"), F.count_if(~F.col("is_current") & F.col("was")).alias("articles_retired"),
        ),
        inserted.select(F.col("inserted").alias("links_inserted"), F.col("removed").alias("links_removed")),
        info.agg(F.count("*").alias("articles_checked"), F.count_if("missing").alias("missing_pages")),
        fresh.agg(F.count("*").alias("leads_fetched")),
        rows.agg(F.count_if(changed).alias("articles_updated")),
    ])
    now = article.where("is_current")
    out = {"article": article, "article_link": pairs, "report": report, "issues": issues, "statuses": now.groupBy("status").agg(F.count("*").alias("n")), "lengths": profile.length_profile(now)}
    publish(out, target, import_id)
    return {name: published(spark, target, name) for name in out}
