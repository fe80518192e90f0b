"""Counts, coverage and percentiles of what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import is_taxon_id, rank_bucket, stub_flags
from quernstone.operators.resolve import reference_counts, resolve_references
from quernstone.operators.validate import count_with_examples


def group_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, value, n) of several columns, nulls kept as groups, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, n): distinct non-null values of each column."""
    return df.agg(*[F.countDistinct(c).alias(c) for c in cols]).unpivot([], cols, "field", "n")


def profile_snapshot(df: DataFrame, distinct: list[str], groups: list[str]) -> DataFrame:
    """(metric, field, value, n): distinct counts and group counts together."""
    d = distinct_counts(df, distinct).select(F.lit("distinct").alias("metric"), "field", F.lit(None).cast("string").alias("value"), "n")
    return d.unionByName(group_counts(df, groups).select(F.lit("group").alias("metric"), "field", "value", "n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every row of a repeated key, and (duplicate_keys, extra_rows)."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    on = [df[k].eqNullSafe(repeated[k]) for k in keys]
    rows = df.join(repeated, on, "left_semi")
    return rows, repeated.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("extra_rows"))


def snapshot_stats(taxa: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Total, current, families and genera of a snapshot, and its last successful run."""
    cur = F.col("is_current")
    out = taxa.agg(F.count("*").alias("total"), F.count_if(cur).alias("current"), F.countDistinct(F.when(cur, F.col("family"))).alias("families"), F.countDistinct(F.when(cur, F.col("genus"))).alias("genera"))
    if runs is None:
        return out
    return out.crossJoin(runs.where("status = 'Succeeded'").agg(F.max_by("import_id", "started_at").alias("last_import")))


def mapping_stats(mapping: DataFrame, taxa: DataFrame, ext: str = "ext_id", key: str = "taxon_id") -> DataFrame:
    """(total, ext_ids, taxa_found, taxa_absent, self_references) of an id mapping."""
    found = taxa.select(F.col(key).alias("__t")).distinct()
    rows = mapping.join(found, mapping[key] == found["__t"], "left")
    has = F.col("__t").isNotNull()
    return rows.agg(
        F.count("*").alias("total"), F.countDistinct(ext).alias("ext_ids"), F.countDistinct(F.when(has, F.col(key))).alias("taxa_found"),
        F.countDistinct(F.when(~has, F.col(key))).alias("taxa_absent"), F.count_if(F.col(ext).cast("string") == F.col(key).cast("string")).alias("self_references"),
    )


def multi_value_keys(pairs: DataFrame, key: str, value: str, limit: int = 20) -> DataFrame:
    """(key, values) of the first ``limit`` keys with several values, by key length and key; values alike.

    Which keys qualify is a count; only the chosen keys' values are ever gathered.
    """
    d = pairs.select(F.col(key).cast("string").alias(key), F.col(value).cast("string").alias(value)).distinct()
    many = d.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.length(key), key).limit(limit)
    lists = d.join(F.broadcast(many), key).groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.length(value).alias("l"), F.col(value).alias("v")))).alias("vs"))
    return lists.select(key, "n", F.array_join(F.transform("vs", lambda s: s.v), ",").alias("values"))


def resolution_report(links: DataFrame) -> DataFrame:
    """(status, n, resolved, accepted, redirected) by status."""
    return links.groupBy("status").agg(F.count("*").alias("n"), F.count("taxon").alias("resolved"), F.count("accepted").alias("accepted"), F.count_if("was_redirected").alias("redirected"))


def item_summary(items: DataFrame, names: DataFrame) -> DataFrame:
    """Counts of current, fetched, titled and pictured items, and of those with an English name."""
    from quernstone.functions.text import is_english

    english = names.where(is_english(F.col("language"))).select("qid", F.lit(1).alias("e")).distinct()
    rows = items.where("is_current").join(english, "qid", "left")
    return rows.agg(F.count("*").alias("current"), F.count("last_rev_id").alias("fetched"), F.count("title").alias("titled"), F.count("image").alias("pictured"), F.count("e").alias("english"))


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(n)


def taxa_with_any(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.where(F.col("key").isin(*keys)).agg(F.countDistinct("symbol").alias("taxa"))


def taxa_with_many_values(facts: DataFrame, key: str, more_than: int = 2) -> DataFrame:
    many = facts.where(F.col("key") == key).groupBy("symbol").agg(F.countDistinct("code").alias("n")).where(F.col("n") > more_than)
    return many.agg(F.count("*").alias("taxa"))


def label_coverage(labelled: DataFrame) -> DataFrame:
    """(key, code, gap, n): non-numeric facts without a label, unmapped if no label row exists, else unresolved."""
    gap = F.when(F.col("confidence").isNull(), "unmapped").otherwise("unresolved")
    return labelled.where("label is null and value_kind <> 'numeric'").groupBy("key", "code", gap.alias("gap")).agg(F.count("*").alias("n"))


def length_profile(articles: DataFrame, text: str = "lead") -> DataFrame:
    """Discrete percentiles of the lengths of Ok leads, and the counts of stubs."""
    rows = articles.where("status = 'Ok'").select(F.length(text).alias("chars"), stub_flags(F.col(text)).alias("s"))

    def pct(p):
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY chars)").cast("long")

    return rows.agg(
        F.count("*").alias("n"), F.min("chars").cast("long").alias("min_chars"), pct(0.1).alias("p10"), pct(0.5).alias("median"), pct(0.9).alias("p90"), F.max("chars").cast("long").alias("max_chars"),
        F.count_if("s.short").alias("short"), F.count_if("s.single").alias("single"), F.count_if("s.stub").alias("stubs"),
    )


def rank_coverage(article_ranks: DataFrame) -> DataFrame:
    """(bucket, articles, ok) over distinct (article, status, bucket), in the fixed order of buckets."""
    order = F.array_position(F.array(*[F.lit(b) for b in ("species", "genus", "infraspecific", "other", "unlinked")]), F.col("bucket"))
    rows = article_ranks.select("title", "status", rank_bucket(F.col("rank")).alias("bucket")).distinct()
    out = rows.groupBy("bucket").agg(F.count("*").alias("articles"), F.count_if(F.col("status") == "Ok").alias("ok"))
    return out.orderBy(order)


def link_report(links: DataFrame, limit: int = 20) -> DataFrame:
    """(status, method, n, examples) of symbol links."""
    return count_with_examples(links, ["status", "method"], F.col("symbol"), limit)


def multi_value_count(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(keys): how many keys have several values; ``multi_value_keys`` shows the first of them."""
    many = pairs.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v")).distinct().groupBy("k").agg(F.count("*").alias("n"))
    return many.agg(F.count_if(F.col("n") > 1).alias("keys"))


def malformed_ids(links: DataFrame, well_formed: Column | None = None, raw: str = "taxon_id_raw", limit: int = 20) -> DataFrame:
    """(malformed, examples): links with a malformed id, and the first distinct ones."""
    ok = is_taxon_id(F.col(raw)) if well_formed is None else well_formed
    bad = links.where(~ok).select(F.col(raw).cast("string").alias("e"))
    first = bad.distinct().orderBy("e").limit(limit).agg(F.array_join(F.array_sort(F.collect_list("e")), "|").alias("examples"))
    return bad.agg(F.count("*").alias("malformed")).crossJoin(first)


def counts_of_current(items: DataFrame, rows: DataFrame, col: str, key: str = "qid") -> DataFrame:
    """(col, n) over the rows of current items: names by language, external ids by property."""
    current = items.where("is_current").select(key).distinct()
    return rows.join(current, key, "left_semi").groupBy(col).agg(F.count("*").alias("n"))


def language_counts(items: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(language, n): the languages with most names of current items."""
    return counts_of_current(items, names, "language").orderBy(F.desc("n"), "language").limit(limit)


def unknown_types(facts: DataFrame, types: DataFrame) -> DataFrame:
    """(type_uri, n) of facts whose type no trait type has."""
    return facts.join(types.select("type_uri"), "type_uri", "left_anti").groupBy("type_uri").agg(F.count("*").alias("n"))


def unlabelled_places(distribution: DataFrame, places: DataFrame) -> DataFrame:
    """(scheme, place_id, n) of places without a label; literals need none."""
    rows = distribution.where("scheme <> 'literal'").join(places.select("scheme", "place_id"), ["scheme", "place_id"], "left_anti")
    return rows.groupBy("scheme", "place_id").agg(F.count("*").alias("n"))


def fact_summary(taxa: DataFrame, facts: DataFrame, types: DataFrame, distribution: DataFrame) -> DataFrame:
    """(metric, value, n): taxa by rank, status and whether current; facts by trait; distribution by kind and scheme."""

    def by(df, metric, value):
        return df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "value", "n")

    current = taxa.where("is_current")
    out = by(current, "rank", F.coalesce("rank", F.lit("(none)")))
    out = out.unionByName(by(current, "status", F.coalesce("status", F.lit("(none)"))))
    out = out.unionByName(by(taxa, "taxa", F.when(F.col("is_current"), "current").otherwise("retired")))
    known = types.select("type_uri", F.col("key").alias("__key"))
    out = out.unionByName(by(facts.join(known, "type_uri", "left"), "trait", F.coalesce("__key", "type_uri")))
    return out.unionByName(by(distribution, "kind", F.col("kind"))).unionByName(by(distribution, "scheme", F.col("scheme")))


def link_totals(links: DataFrame, taxa: DataFrame) -> DataFrame:
    """(status, method, n, to_synonym, with_accepted) of symbol links."""
    t = taxa.select(F.col("taxon_id").alias("__t"), F.col("status").alias("__status"))
    rows = links.join(t, F.col("taxon") == F.col("__t"), "left")
    return rows.groupBy("status", "method").agg(F.count("*").alias("n"), F.count_if(F.col("__status") == "Synonym").alias("to_synonym"), F.count("accepted").alias("with_accepted"))


def symbols_with_ext_id(links: DataFrame, ext_ids: DataFrame) -> DataFrame:
    """(status, symbols, with_ext_id): symbols by the status of their link, and how many of them an external id names."""
    named = ext_ids.select(F.col("value").alias("symbol"), F.lit(1).alias("__named")).distinct()
    return links.join(named, "symbol", "left").groupBy("status").agg(F.count("*").alias("symbols"), F.count("__named").alias("with_ext_id"))


def snapshot_relations(taxa: DataFrame, refs: list[str], key: str = "taxon_id") -> DataFrame:
    """(reference, resolved, unresolved) of each relation of current taxa."""
    return reference_counts(resolve_references(taxa, refs, key).where("is_current"), refs)


def snapshot_groups(taxa: DataFrame, cols: list[str]) -> DataFrame:
    """(field, value, n) of current taxa."""
    return group_counts(taxa.where("is_current"), cols)
