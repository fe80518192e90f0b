"""Ranked name search for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import compact_name, is_english, match_tier, normalize_name, rank_depth
from quernstone.operators.dedup import first_per_key, top_per_group
from quernstone.operators.resolve import best_name, live
from quernstone.session import written

BROADCAST_QUERIES = 1000  # with more, names and queries meet on their trigrams
PAGE = 20


def queries_of(queries: DataFrame) -> DataFrame:
    """(query, nq, cq) of the valid ones: trimmed, 2 to 200 characters, distinct."""
    q = queries.select(F.btrim("query").alias("query")).where(F.length("query").between(2, 200)).distinct()
    q = q.withColumn("nq", normalize_name(F.col("query")))
    return q.withColumn("cq", compact_name(F.col("nq")))


def grams(c, size: int):
    """The distinct pieces of ``size`` characters of a text."""
    n = F.length(c)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, queries: DataFrame, query: str, few: bool) -> DataFrame:
    """Rows of ``texts`` with each query that ``text`` contains, both lower-cased.

    A small batch of queries, counted beforehand, is broadcast and tried on each row. In a large one each query is
    looked up under its trigram that the fewest texts hold (one that no text holds finds nothing); a query of one or
    two characters is its own gram.
    """
    hit = F.contains(F.lower(text), F.lower(query))
    if few:
        return texts.join(F.broadcast(queries), hit)
    out = None
    for size in (1, 2, 3):
        own = queries.where(F.least(F.length(query), F.lit(3)) == size)
        held = texts.withColumn("__g", F.explode(grams(F.lower(text), size)))
        df = held.groupBy("__g").agg(F.count("*").alias("__df"))
        rest = F.struct(*queries.columns).alias("__q")
        rare = own.select(rest, F.explode(grams(F.lower(query), size)).alias("__g")).join(df, "__g", "left")
        rare = rare.groupBy("__q").agg(F.min_by("__g", F.struct(F.coalesce("__df", F.lit(0)), "__g")).alias("__g"))
        found = held.join(rare.select("__q.*", "__g"), "__g").where(hit).drop("__g")
        out = found if out is None else out.unionByName(found)
    return out


def scientific_texts(taxa: DataFrame) -> DataFrame:
    """(target, matched_on, source_order, matched_text, both) of current taxa; a synonym leads to its accepted taxon."""
    current = taxa.where("is_current")
    accepted = current.select(F.col("taxon_id").alias("__a"))
    # only synonyms move: the others would meet on null; ids are merged, a compressed file says little about its rows
    leads = F.coalesce((F.col("status") == "Synonym") & F.col("accepted_id").isNotNull(), F.lit(False))
    t = current.where(leads).join(accepted.hint("merge"), F.col("accepted_id") == F.col("__a"), "left")
    t = t.unionByName(current.where(~leads), allowMissingColumns=True)
    via = F.col("__a").isNotNull()
    return t.select(F.coalesce("__a", "taxon_id").alias("target"), F.when(via, "synonym").otherwise("scientificName").alias("matched_on"), via.cast("int").alias("source_order"), F.col("name").alias("matched_text"), F.concat_ws("\n", "name", "genus").alias("both"))


def common_texts(names: DataFrame, item_links: DataFrame) -> DataFrame:
    """(target, matched_text, normalized, compact) of English names of items with a current link."""
    link = live(item_links).select("qid", F.coalesce("accepted", "taxon").alias("target"))
    return names.where(is_english(F.col("language"))).join(link.hint("merge"), "qid").select("target", F.col("name").alias("matched_text"), "normalized", "compact")


def scientific_tier() -> Column:
    return F.coalesce(match_tier(F.col("matched_text"), F.col("query")), F.lit(40))


def common_tier() -> Column:
    tier = match_tier(F.col("normalized"), F.col("nq"))
    return F.when(tier == 10, 10).when(F.col("compact") == F.col("cq"), 15).otherwise(F.coalesce(tier, F.lit(50)))


MATCH = ["query", "target", "matched_on", "source_order", "matched_text", "tier"]


def pages(matches: DataFrame, q: DataFrame, taxa: DataFrame, names: DataFrame, item_links: DataFrame, page_size: int) -> DataFrame:
    """The first ``page_size`` targets of each query of ``q`` from MATCH rows, with a common name each."""
    current = taxa.where("is_current")
    best = first_per_key(matches.where("target is not null"), ["query", "target"], [F.col("tier"), F.col("source_order"), F.length("matched_text"), F.col("matched_text"), F.col("matched_on")])
    rows = best.join(current.select(F.col("taxon_id").alias("target"), "name", "rank", "status").hint("merge"), "target")
    order = [F.asc("tier"), F.asc(F.col("matched_on") == "synonym"), F.asc(~F.col("status").eqNullSafe(F.lit("Accepted"))), F.asc(rank_depth(F.col("rank"))), F.asc_nulls_last("name"), F.asc("target")]
    page = top_per_group(rows, ["query"], order, page_size)
    labels = best_name(page.select("query", "target").join(q, "query"), names, item_links)
    out = page.join(labels, ["query", "target"], "left")
    return out.select("query", "position", F.col("target").alias("taxon_id"), "name", "rank", "status", "common_name", "matched_on", "matched_text", "tier")


def checked(page_size: int) -> None:
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be 1 to 100")


def search_names(taxa: DataFrame, names: DataFrame, item_links: DataFrame, queries: DataFrame, page_size: int = PAGE) -> DataFrame:
    """(query, position, taxon_id, name, rank, status, common_name, matched_on, matched_text, tier).

    ``taxa`` (taxon_id, name, genus, rank, status, accepted_id, is_current), ``names`` (qid, language, name, normalized,
    compact), ``item_links`` (qid, taxon, accepted and optionally is_current: retired links do not count). Scientific and
    common names match in tiers; each target keeps its best match, and each query its first ``page_size`` targets.

    This looks at every name; ``search_index`` does not.
    """
    checked(page_size)
    q = written(queries_of(queries), "queries")
    few = q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    scientific = containing(scientific_texts(taxa), "both", q.select("query"), "query", few).withColumn("tier", scientific_tier())
    n = common_texts(names, item_links)
    nq = q.where(F.col("nq") != "").select("query", "nq", F.nullif(F.col("cq"), F.lit("")).alias("cq"))
    if few:  # one pass for both forms
        found = n.join(F.broadcast(nq), F.contains("normalized", "nq") | F.coalesce(F.contains("compact", "cq"), F.lit(False)))
    else:
        found = containing(n, "normalized", nq, "nq", few).unionByName(containing(n, "compact", nq.where("cq is not null"), "cq", few))
    common = found.select("query", "target", F.lit("commonName").alias("matched_on"), F.lit(2).alias("source_order"), "matched_text", common_tier().alias("tier"))
    return pages(scientific.select(*MATCH).unionByName(common), q, taxa, names, item_links, page_size)
