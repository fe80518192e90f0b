"""Articles that belong to items: selection by title, and updates from landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import lead_status
from quernstone.operators.snapshot import change_only_upsert


def select_titles(items: DataFrame, articles: DataFrame, import_id: int) -> tuple[DataFrame, DataFrame]:
    """The articles after selection, and the current (qid, title) pairs.

    A new title comes in as Pending, a retired one returns as it was, one no item names any more is retired.
    """
    pairs = items.where("is_current and title is not null").select("qid", "title").distinct()
    known = articles.select("title", F.col("status").alias("__s"))
    stage = pairs.select("title").distinct().join(known, "title", "left").select("title", F.coalesce("__s", F.lit("Pending")).alias("status"))
    return change_only_upsert(articles, stage, ["title"], ["status"], import_id), pairs


def title_link_counts(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(inserted, removed): (qid, title) pairs that are new, and links that no pair stands for any more."""
    key = ["qid", "title"]
    new = pairs.select(*key).distinct().withColumn("__n", F.lit(1))
    rows = new.join(links.select(*key).distinct().withColumn("__o", F.lit(1)), key, "full")
    return rows.agg(F.count_if(F.col("__o").isNull()).alias("inserted"), F.count_if(F.col("__n").isNull()).alias("removed"))


def apply_article_updates(articles: DataFrame, info: DataFrame, leads: DataFrame, requesting: DataFrame) -> DataFrame:
    """Articles with status, lead, rev and fetched_at after a round of page information and leads, and ``changed``.

    ``info`` (title, missing, disambiguation, item, rev); ``leads`` (title, lead, rev, fetched_at); ``requesting``
    (title, qids). A missing page keeps its text; a disambiguation page loses it. Whether there is a fetch time
    counts as content, its value does not.
    """
    i = info.select("title", F.col("missing").alias("i_missing"), F.col("disambiguation").alias("i_dis"), F.col("item").alias("i_item"), F.col("rev").alias("i_rev"))
    ld = leads.select("title", F.col("lead").alias("l_lead"), F.col("rev").alias("l_rev"), F.col("fetched_at").alias("l_at"), F.lit(True).alias("got"))
    rows = articles.join(i, "title").join(ld, "title", "left").join(requesting, "title", "left")
    gone, dis = F.coalesce("i_missing", F.lit(False)), F.coalesce("i_dis", F.lit(False))
    fresh = F.coalesce("got", F.lit(False))

    def pick(old, on_dis, new):
        return F.when(gone, F.col(old)).when(dis, on_dis).when(fresh, F.col(new)).otherwise(F.col(old))

    lead, rev = pick("lead", F.lit(None), "l_lead"), pick("rev", F.col("i_rev"), "l_rev")
    at = pick("fetched_at", F.lit(None), "l_at")
    out = rows.select("title", lead_status(gone, dis, F.col("i_item"), F.col("qids"), lead).alias("status"), lead.alias("lead"), rev.alias("rev"), at.alias("fetched_at"), F.struct("status", "lead", "rev", F.col("fetched_at").isNull().alias("n")).alias("before"))
    after = F.struct("status", "lead", "rev", F.col("fetched_at").isNull().alias("n"))
    return out.withColumn("changed", ~F.col("before").eqNullSafe(after)).drop("before")
