"""References, replacement chains, cross-source links and accepted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import canonical_name, is_blank, is_taxon_id, normalize_ext_id, with_normalized
from quernstone.operators.lookup import referenced
from quernstone.operators.validate import GateClosed
from quernstone.session import written

MAX_DEPTH = 64


def live(table: DataFrame) -> DataFrame:
    """The rows that are current, if the table says so."""
    return table.where("is_current") if "is_current" in table.columns else table


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key no parent has."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def missing_parent_summary(occ: DataFrame, facts: DataFrame, taxa: DataFrame, symbol: str = "symbol", occurrence: str = "occurrence_id", row: str = "row_no") -> DataFrame:
    """(symbol, occurrences, facts, first_row) of each symbol that occurrences name and taxa lack."""
    lost = occ.join(taxa.select(symbol), symbol, "left_anti").select(symbol, occurrence, row)
    per = facts.groupBy(occurrence).agg(F.count("*").alias("f"))
    return lost.join(per, occurrence, "left").groupBy(symbol).agg(F.countDistinct(occurrence).alias("occurrences"), F.sum(F.coalesce("f", F.lit(0))).alias("facts"), F.min(row).alias("first_row"))


def resolve_references(df: DataFrame, ref_cols: list[str], key: str) -> DataFrame:
    """For each id column a column resolved_<col>: the id if a current row has it, else null. Raw ids stay.

    Null references and ids that many rows name are dealt over the tasks.
    """
    return referenced(df, {c: f"resolved_{c}" for c in ref_cols}, live(df).select(key))


def reference_counts(resolved: DataFrame, ref_cols: list[str]) -> DataFrame:
    """(reference, resolved, unresolved) of each id column, in one pass."""
    parts = [F.struct(F.lit(c).alias("reference"), F.count_if(F.col(f"resolved_{c}").isNotNull()).alias("resolved"), F.count_if(F.col(c).isNotNull() & F.col(f"resolved_{c}").isNull()).alias("unresolved")) for c in ref_cols]
    return resolved.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def refresh_links(table: DataFrame, taxa: DataFrame, id_cols: list[str], key: str = "taxon_id") -> DataFrame:
    """Each id column's resolved_<col> against the taxa, and ``changed`` if any differs from before."""
    out, changed = referenced(table, {c: f"__{c}" for c in id_cols}, taxa.select(key)), F.lit(False)
    for c in id_cols:
        changed = changed | ~F.col(f"resolved_{c}").eqNullSafe(F.col(f"__{c}"))
    out = out.withColumn("changed", changed)
    return out.withColumns({f"resolved_{c}": F.col(f"__{c}") for c in id_cols}).drop(*[f"__{c}" for c in id_cols])


def resolve_chain(ids: DataFrame, edges: DataFrame, current: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, resolved, status, was_redirected) of each distinct id, following old -> new.

    Resolved or NotFound at a node without an edge, Cycle at the first repeated node, DepthLimit if node ``max_depth``
    still has an edge. ``edges`` (old_id, new_id) has at most one edge a source; several refuse the call.

    Pointer doubling: each step doubles the length of the jumps, so a chain of 64 takes seven joins, and shorter ones
    stop as soon as no jump can grow. Tables that grow with the ids are merged and never broadcast: their files are small
    when compressed, their rows are not. A cycle never ends, so what has not ended after the last jump is on a cycle or
    too long; only those few are walked node by node, to find out which, and where they repeat.
    """
    ids = ids.select(F.col("id")).dropna().distinct()
    first = written(edges.select(F.col("old_id").alias("f"), F.col("new_id").alias("t"), F.lit(1).cast("long").alias("d")), "jump")
    if not first.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise GateClosed("several edges leave one id")
    jumps, length, growing = [first], 1, True
    while growing and length < max_depth + 1:
        h = jumps[-1]
        b = h.select(F.col("f").alias("m"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        # a jump that ends early keeps its shorter length
        longer = h.join(b.hint("merge"), h.t == b.m, "left").select("f", F.coalesce("t2", "t").alias("t"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        jumps.append(written(longer, "jump"))
        length *= 2
        growing = not jumps[-1].where(F.col("d") == length).isEmpty()
    far = jumps[-1]
    end = ids.join(far.hint("merge"), ids.id == far.f, "left").select("id", F.coalesce("t", "id").alias("end"), F.coalesce("d", F.lit(0)).alias("d"))
    found = current.select(F.col(current.columns[0]).alias("__c")).distinct()
    if not growing and length <= max_depth:
        return _ended(end, found)
    more = first.select(F.col("f").alias("__o"))
    end = written(end.join(more.hint("merge"), end.end == more["__o"], "left").withColumn("long", F.col("__o").isNotNull() | (F.col("d") > max_depth)).drop("__o"), "ends")
    walked = _walked(end.where("long").select("id"), jumps, max_depth)
    return _ended(end.where("not long"), found).unionByName(walked.withColumn("was_redirected", F.col("id") != F.col("resolved")))


def _ended(end: DataFrame, found: DataFrame) -> DataFrame:
    """The result for ids whose chains end: (id, end) against the current ids."""
    rows = end.join(found.hint("merge"), F.col("end") == F.col("__c"), "left")
    status = F.when(F.col("__c").isNotNull(), "Resolved").otherwise("NotFound")
    return rows.select("id", F.col("end").alias("resolved"), status.alias("status"), (F.col("id") != F.col("end")).alias("was_redirected"))


def _walked(ids: DataFrame, jumps: list[DataFrame], max_depth: int) -> DataFrame:
    """(id, resolved, status) of ids on cycles or on chains that are too long.

    Each id gets a row for every step up to the limit; jumps of one, two, four, ... edges that add up to the step
    give its node. The first node that comes a second time closes a cycle.
    """
    steps = ids.select("id", F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(max_depth + 1))).alias("step"))
    for k, jump in enumerate(jumps):
        whole = jump.where(F.col("d") == 1 << k).select(F.col("f").alias(f"f{k}"), F.col("t").alias(f"t{k}"))
        on = (F.col("node") == F.col(f"f{k}")) & (F.col("step").bitwiseAND(1 << k) != 0)
        steps = steps.join(whole.hint("merge"), on, "left").select("id", "step", F.when(F.col("step").bitwiseAND(1 << k) != 0, F.col(f"t{k}")).otherwise(F.col("node")).alias("node"))
    steps = written(steps.where("node is not null"), "steps")
    nth = F.row_number().over(Window.partitionBy("id", "node").orderBy("step"))
    again = steps.withColumn("nth", nth).where("nth = 2").groupBy("id").agg(F.min_by("node", "step").alias("again"))
    last = steps.where(F.col("step") == max_depth).select("id", "node")
    rows = ids.join(again, "id", "left").join(last, "id", "left")
    return rows.select("id", F.coalesce("again", "node").alias("resolved"), F.when(F.col("again").isNotNull(), "Cycle").otherwise("DepthLimit").alias("status"))


def validate_chain_graph(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cycles, too_long): how many starts reach a cycle or exceed the depth; either blocks publication."""
    out = resolve_chain(edges.select(F.col("old_id").alias("id")), edges, edges.select("new_id"), max_depth)
    return out.agg(F.count_if(F.col("status") == "Cycle").alias("cycles"), F.count_if(F.col("status") == "DepthLimit").alias("too_long"))


def accepted_of(taxa: DataFrame) -> DataFrame:
    """(taxon_id, accepted): itself if Accepted, the current accepted taxon if Synonym, else null; current taxa only."""
    current = taxa.where("is_current").select("taxon_id", "status", "accepted_id")
    rows = referenced(current, {"accepted_id": "__a"}, current.select("taxon_id"))
    accepted = F.when(F.col("status") == "Accepted", F.col("taxon_id")).when(F.col("status") == "Synonym", F.col("__a"))
    return rows.select("taxon_id", accepted.alias("accepted"))


def resolve_item_links(links: DataFrame, edges: DataFrame, taxa: DataFrame, well_formed: Column | None = None) -> DataFrame:
    """``links`` (qid, taxon_id_raw) with resolved id, taxon, accepted and status; names play no part."""
    ok = is_taxon_id(F.col("taxon_id_raw")) if well_formed is None else well_formed
    links = links.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    current = taxa.where("is_current").select("taxon_id")
    chains = resolve_chain(links.where("__ok").select(F.col("taxon_id_raw").alias("id")), edges, current)
    rows = links.join(chains.withColumnRenamed("status", "__chain"), F.col("__ok") & (links.taxon_id_raw == chains.id), "left")
    acc = accepted_of(taxa).select(F.col("taxon_id").alias("__t"), "accepted")
    rows = rows.join(acc, (F.col("resolved") == F.col("__t")) & (F.col("__chain") == "Resolved"), "left")
    status = F.when(~F.col("__ok"), "NotFound").otherwise(F.col("__chain"))
    return rows.select(*[links[c] for c in links.columns if c != "__ok"], "resolved", F.col("__t").alias("taxon"), "accepted", status.alias("status"), F.coalesce("was_redirected", F.lit(False)).alias("was_redirected"))


def link_by_precedence(symbols: DataFrame, ext_ids: DataFrame, item_links: DataFrame, taxa: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(symbol, taxon, method, status, candidates, qids) of each symbol; ``qids`` are the items behind an external link.

    First the external id: one taxon links, several conflict and end there. Else name and rank among current taxa.
    ``symbols`` (symbol, name, rank); ``ext_ids`` (qid, value); ``item_links`` (qid, taxon); ``taxa`` (taxon_id, name,
    rank, is_current); ``items`` (qid, is_current). Only current items, links and taxa count: rows of these tables with
    is_current false are left out, and with ``items`` given, ids of items that it lacks.
    """
    current = taxa.where("is_current")
    ids = live(ext_ids).select("qid", F.col("value").alias("symbol"))
    if items is not None:
        ids = ids.join(live(items).select("qid").distinct(), "qid", "left_semi")
    via = symbols.select("symbol").join(ids, "symbol").join(live(item_links).select("qid", "taxon"), "qid")
    via = via.join(current.select(F.col("taxon_id").alias("taxon")), "taxon", "left_semi")
    via = via.groupBy("symbol").agg(F.array_sort(F.collect_set("taxon")).alias("candidates"), F.array_sort(F.collect_set(F.col("qid").cast("string"))).alias("qids"))
    one = via.select("symbol", F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("taxon"), F.lit("external").alias("method"), F.when(F.size("candidates") == 1, "Linked").otherwise("Conflict").alias("status"), "candidates", "qids")
    rest = symbols.join(via.select("symbol"), "symbol", "left_anti").withColumn("__c", canonical_name(F.col("name"), F.col("rank")))
    rest = with_normalized(rest, "__c", "__n")
    names = with_normalized(current.select("taxon_id", "name", "rank"), "name", "__n").drop("name")
    names = names.groupBy("__n", "rank").agg(F.array_sort(F.collect_set("taxon_id")).alias("candidates"))
    # many symbols may share a name that many taxa have: the name's taxa are gathered once, and only symbols with several
    # names have theirs put together
    asked = rest.groupBy("symbol").agg(F.collect_set(F.struct("__n", "rank")).alias("__k"))
    none = F.array().cast(names.schema["candidates"].dataType)
    single = asked.where(F.size("__k") == 1).select("symbol", F.inline("__k")).join(names, ["__n", "rank"], "left").select("symbol", F.coalesce("candidates", none).alias("candidates"))
    more = asked.where(F.size("__k") > 1).select("symbol", F.inline("__k")).join(names, ["__n", "rank"], "left").select("symbol", F.explode_outer("candidates").alias("taxon_id"))
    by = single.unionByName(more.groupBy("symbol").agg(F.array_sort(F.collect_set("taxon_id")).alias("candidates")))
    n = F.size("candidates")
    two = by.select("symbol", F.when(n == 1, F.get("candidates", F.lit(0))).alias("taxon"), F.lit("name").alias("method"), F.when(n == 1, "Linked").when(n > 1, "Ambiguous").otherwise("NotFound").alias("status"), "candidates", F.array().cast("array<string>").alias("qids"))
    return one.unionByName(two)


def link_evidence(links: DataFrame, taxa: DataFrame) -> DataFrame:
    """(symbol, status, qids, candidates) of the symbols whose link has something to show for it.

    A linked one by external id has its items; a conflict has the items and the candidates, an ambiguous name its
    candidates, each described by taxon_id, name and status in the order of the ids.
    """
    several = F.col("status").isin("Conflict", "Ambiguous")
    shown = links.where((F.size("qids") > 0) | several)
    rows = shown.where(several).select("symbol", F.explode("candidates").alias("taxon_id")).join(live(taxa).select("taxon_id", "name", "status"), "taxon_id", "left")
    told = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("taxon_id", "name", "status"))).alias("candidates"))
    return shown.select("symbol", "status", "qids").join(told, "symbol", "left").select("symbol", "status", "qids", "candidates")


def lookup_ext_id(ids: DataFrame, mapping: DataFrame, edges: DataFrame, taxa: DataFrame) -> DataFrame:
    """(query, status, taxon) of each queried external id: Found, NotFound, Conflict or Invalid.

    ``mapping`` (normalized_id, taxon_id). Several mapped ids that end at one taxon are no conflict; a chain that
    cycles or is too long is one.
    """
    q = ids.select("query").distinct().withColumn("id_", normalize_ext_id(F.col("query")))
    bad = is_blank(F.col("query")) | (F.length("query") > 200)
    hits = q.where(~bad).join(mapping.select(F.col("normalized_id").alias("id_"), "taxon_id").distinct(), "id_")
    current = taxa.where("is_current").select("taxon_id")
    chain = resolve_chain(hits.select(F.col("taxon_id").alias("id")), edges, current)
    ends = hits.join(chain, hits.taxon_id == chain.id).groupBy("query").agg(
        F.count_if(F.col("status").isin("Cycle", "DepthLimit")).alias("broken"),
        F.countDistinct(F.when(F.col("status") == "Resolved", F.col("resolved"))).alias("n"),
        F.min(F.when(F.col("status") == "Resolved", F.col("resolved"))).alias("taxon"),
    )
    rows = q.join(ends, "query", "left")
    status = F.when(bad, "Invalid").when((F.col("broken") > 0) | (F.col("n") > 1), "Conflict").when(F.coalesce("n", F.lit(0)) == 0, "NotFound").otherwise("Found")
    return rows.select("query", status.alias("status"), F.when(status == "Found", F.col("taxon")).alias("taxon"))


def taxon_detail(ids: DataFrame, edges: DataFrame, taxa: DataFrame, relations: list[str]) -> DataFrame:
    """The record that each id resolves to, with (id, name) of each related current record."""
    current = taxa.where("is_current")
    chain = resolve_chain(ids, edges, current.select("taxon_id"))
    # the node at which a walk was given up is not the record asked for
    out = chain.join(current.hint("merge"), (chain.resolved == current.taxon_id) & (chain.status != "DepthLimit"), "left").drop("taxon_id")
    for r in relations:
        other = current.select(F.col("taxon_id").alias("__i"), F.struct(F.col("taxon_id").alias("id"), F.col("name").alias("name")).alias(f"{r}_record")).withColumn("__at", F.pmod(F.xxhash64("__i"), F.lit(1)))
        # records without the relation match nothing and are dealt over the tasks
        out = out.withColumn("__lot", F.when(F.col(r).isNull(), F.xxhash64("id")).otherwise(0))
        out = out.join(other.hint("merge"), (out[r] == other["__i"]) & (out["__lot"] == other["__at"]), "left").drop("__i", "__at", "__lot")
    return out


def trace_path(symbols: DataFrame, symbol_links: DataFrame, taxa: DataFrame, item_links: DataFrame, articles: DataFrame, limit: int = 3) -> DataFrame:
    """(symbol, taxon, qid, title, own): at most ``limit`` articles a symbol, those of its own taxon first.

    The taxon is the accepted one of the symbol's link, else the first current accepted taxon with the symbol's name.
    ``symbols`` (symbol, name); ``symbol_links`` (symbol, accepted); ``taxa`` (taxon_id, name, status, is_current);
    ``item_links`` (qid, taxon, accepted) and ``articles`` (qid, title) count where is_current, if they say so.

    An OR over two id columns is two equi-joins.
    """
    from quernstone.operators.dedup import top_per_group

    links, pages = live(item_links), live(articles)
    named = taxa.where("is_current and status = 'Accepted'").groupBy("name").agg(F.min("taxon_id").alias("__by_name"))
    linked = symbol_links.where("accepted is not null").groupBy("symbol").agg(F.min("accepted").alias("accepted"))
    base = symbols.select("symbol", "name").join(linked, "symbol", "left").join(named, "name", "left")
    base = base.select("symbol", F.coalesce("accepted", "__by_name").alias("taxon")).where("taxon is not null").distinct()
    own = base.join(links.select(F.col("taxon"), "qid"), "taxon").withColumn("own", F.lit(True))
    via = base.join(links.where("accepted is not null and not accepted <=> taxon").select(F.col("accepted").alias("taxon"), "qid"), "taxon").withColumn("own", F.lit(False))
    rows = own.unionByName(via).join(pages.select("qid", "title"), "qid")
    top = top_per_group(rows, ["symbol"], [F.desc("own"), F.asc("qid"), F.asc("title")], limit)
    return top.select("symbol", "taxon", "qid", "title", "own")


def best_name(targets: DataFrame, names: DataFrame, item_links: DataFrame) -> DataFrame:
    """(target, common_name): one English name a taxon: plain en first, names that match the query, shortest, byte order.

    ``targets`` (target and optionally query, nq and cq: the normalised query and its compact form); ``names`` (qid,
    language, name, normalized, compact); the link's accepted taxon counts, else its own; retired links do not. A name
    matches if its normalised form holds the normalised query, or its compact form the compact one.
    """
    from quernstone.functions.text import is_english

    keys = [c for c in ("query", "target") if c in targets.columns]
    link = live(item_links).select("qid", F.coalesce("accepted", "taxon").alias("target")).distinct()
    english = names.where(is_english(F.col("language"))).join(link.hint("merge"), "qid")
    rows = targets.join(english, "target")
    matched = F.lit(False)
    if "query" in keys:
        holds = F.contains("normalized", "nq") | ((F.col("cq") != "") & F.contains("compact", "cq"))
        matched = (F.col("nq") != "") & F.coalesce(holds, F.lit(False))
    order = F.struct((F.col("language") != "en").alias("a"), (~matched).alias("b"), F.length("name").alias("c"), F.col("name").alias("d"))
    return rows.groupBy(*keys).agg(F.min_by("name", order).alias("common_name"))


def coverage(taxa: DataFrame, links: DataFrame) -> DataFrame:
    """(accepted_species, linked, percent): accepted species with a current link; half-even to two places."""
    species = taxa.where("is_current and status = 'Accepted' and rank = 'species'").select("taxon_id").distinct()
    linked = links.select(F.col("accepted").alias("taxon_id"), F.lit(1).alias("hit")).dropna().distinct()
    rows = species.join(linked, "taxon_id", "left").agg(F.count("*").alias("accepted_species"), F.count("hit").alias("linked"))
    return rows.withColumn("percent", F.when(F.col("accepted_species") > 0, F.bround(F.col("linked") * 100.0 / F.col("accepted_species"), 2)))


def present_and_native(distribution: DataFrame, places: DataFrame, country: str, admin: str, native_in: str) -> DataFrame:
    """(present, present_and_native): distinct taxa present in a division, and those of them native in a place."""
    here = places.where((F.col("country_code") == country) & (F.col("admin_code") == admin)).select("place_id")
    present = distribution.where("kind = 'Present'").join(here, "place_id", "left_semi").select("symbol").distinct()
    native = distribution.where((F.col("kind") == "Native") & (F.col("place_id") == native_in)).select("symbol", F.lit(1).alias("n")).distinct()
    return present.join(native, "symbol", "left").agg(F.count("*").alias("present"), F.count("n").alias("present_and_native"))
