"""Whole imports: sources, validation, gates, resolution and publication put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import canonical_name, classify_place, empty_to_null
from quernstone.operators import facts as facts_
from quernstone.operators import profile, resolve, snapshot, validate
from quernstone.operators.dedup import dictionary_encode, first_per_key
from quernstone.operators.lookup import referenced
from quernstone.session import written
from quernstone.sinks.publish import publish
from quernstone.sources import delimited, landed

DWC, EOL, DC = "http://rs.tdwg.org/dwc/terms/", "http://eol.org/schema/", "http://purl.org/dc/terms/"
# Row types and terms of the trait archive, in order.
ARCHIVE = {
    "taxa": (DWC + "Taxon", [DWC + "taxonID", DC + "source", *[DWC + t for t in ("scientificName", "family", "taxonRank", "taxonomicStatus")]]),
    "occurrences": (DWC + "Occurrence", [DWC + "occurrenceID", DWC + "taxonID", EOL + "terms/bodyPart", DWC + "lifeStage"]),
    "facts": (
        DWC + "MeasurementOrFact",
        [
            DWC + "measurementID", DWC + "occurrenceID", EOL + "measurementOfTaxon", EOL + "associationID", EOL + "parentMeasurementID",
            DWC + "measurementType", DWC + "measurementValue", DWC + "measurementUnit", DWC + "measurementAccuracy",
            EOL + "terms/statisticalMethod", DWC + "measurementDeterminedDate", DWC + "measurementDeterminedBy", DWC + "measurementMethod",
            DWC + "measurementRemarks", DC + "source", DC + "bibliographicCitation", DC + "contributor", EOL + "reference/referenceID",
        ],
    ),
}
TAXON_COLUMNS = ["name", "authorship", "rank", "status", "family", "genus", "parent_id", "accepted_id", "original_id"]


def import_taxonomy(spark: SparkSession, path: str, current: DataFrame | None, target: str, import_id: int) -> dict[str, DataFrame]:
    """Read, validate, gate, upsert, resolve and publish a taxonomy snapshot; returns what was published."""
    rows, issues = delimited.scan_taxonomy_tsv(spark, path)
    rows = written(rows, "taxonomy")
    _, repeated = profile.duplicate_keys(rows, ["taxonID"])
    errors = issues.agg(F.count_if(F.col("severity") == "error").alias("rejected"))
    metrics = errors.crossJoin(repeated).crossJoin(rows.agg(F.count("*").alias("rows")))
    validate.gate(metrics, {"rejected": "rejected = 0", "duplicates": "duplicate_keys = 0", "rows": "rows > 0"})
    stage = rows.select(
        F.col("taxonID").alias("taxon_id"), F.col("scientificName").alias("name"), F.col("scientificNameAuthorship").alias("authorship"), F.col("taxonRank").alias("rank"),
        F.col("taxonomicStatus").alias("status"), "family", "genus", F.col("parentNameUsageID").alias("parent_id"), F.col("acceptedNameUsageID").alias("accepted_id"), F.col("originalNameUsageID").alias("original_id"),
    )
    before = stage.limit(0).withColumns({"is_current": F.lit(True), "import_id": F.lit(0).cast("long")}) if current is None else current
    refs = ["parent_id", "accepted_id", "original_id"]
    taxa = snapshot.snapshot_upsert(before.select(*stage.columns, "is_current", "import_id"), stage, ["taxon_id"], TAXON_COLUMNS, import_id)
    taxa = written(resolve.resolve_references(taxa, refs, "taxon_id"), "taxa")
    # the resolved ids of retired rows are cleared
    taxa = taxa.withColumns({f"resolved_{c}": F.when(F.col("is_current"), F.col(f"resolved_{c}")) for c in refs})
    out = {"taxon": taxa, "issues": issues, "profile": profile.profile_snapshot(stage, ["name", "family", "genus"], ["rank", "status"]), "references": resolve.reference_counts(taxa.where("is_current"), refs)}
    publish(out, target, import_id)
    return out


def import_crosswalk(spark: SparkSession, path: str, current: DataFrame | None, edges: DataFrame, taxa: DataFrame, target: str, import_id: int, allow_shrink: bool = False) -> dict[str, DataFrame]:
    """Read landed statements, guard against shrinking, upsert only changes, resolve and publish the links."""
    rows, issues = landed.scan_sparql_results(spark, path)
    preferred = (F.col("statement_rank") != "preferred").cast("int")
    stage = written(first_per_key(rows.select("qid", F.col("ext_id").alias("taxon_id_raw"), "statement_rank"), ["qid", "taxon_id_raw"], [preferred]), "statements")
    before = stage.limit(0).withColumns({"is_current": F.lit(True), "import_id": F.lit(0).cast("long")}) if current is None else current.select("qid", "taxon_id_raw", "statement_rank", "is_current", "import_id")
    validate.shrink_guard(stage.count(), before.where("is_current").count(), allow_shrink)
    links = snapshot.change_only_upsert(before, stage, ["qid", "taxon_id_raw"], ["statement_rank"], import_id)
    links = written(resolve.resolve_item_links(links, edges, taxa), "links")
    live = links.where("is_current")
    out = {"item_link": links, "issues": issues, "report": profile.resolution_report(live), "several": profile.multi_value_keys(live, "qid", "taxon_id_raw"), "coverage": resolve.coverage(taxa, live)}
    publish(out, target, import_id)
    return out


def import_traits(spark: SparkSession, folder: str, seeds: dict[str, DataFrame], current: DataFrame | None, taxa: DataFrame, ext_ids: DataFrame, item_links: DataFrame, target: str, import_id: int) -> dict[str, DataFrame]:
    """Read the trait archive, validate, attribute and label its facts, link its symbols, and publish all tables.

    ``seeds`` has trait_type, code_label and place_label. Rows that name an unknown symbol are skipped with one warning
    a symbol; facts without an occurrence refuse the import.
    """
    tables = delimited.scan_dwca_tsv(spark, folder, ARCHIVE, "row_no")
    required = {"taxa": ["taxonID", "scientificName"], "occurrences": ["occurrenceID", "taxonID"], "facts": ["occurrenceID", "measurementType"]}
    good, issues = {}, None
    for name, (rows, broken) in tables.items():
        ok, found = validate.split_valid(rows, required[name], required[name], name, rows.columns[0], row="row_no")
        good[name] = written(ok, name)
        both = broken.unionByName(found.withColumnRenamed("row_no", "row"))
        issues = both if issues is None else issues.unionByName(both)
    occ = good["occurrences"].select(F.col("occurrenceID").alias("occurrence_id"), F.col("taxonID").alias("symbol"), "row_no")
    raw = good["facts"].select(F.col("occurrenceID").alias("occurrence_id"), F.col("measurementType").alias("type_uri"), F.coalesce("measurementValue", F.lit("")).alias("value_raw"), empty_to_null(F.col("measurementUnit")).alias("unit"), empty_to_null(F.col("measurementRemarks")).alias("remark_sha"))
    source = good["taxa"].select(F.col("taxonID").alias("symbol"), F.col("scientificName").alias("name_raw"), empty_to_null(F.col("taxonRank")).alias("rank"), empty_to_null(F.col("taxonomicStatus")).alias("status"))
    source = source.withColumn("name", canonical_name(F.col("name_raw"), F.col("rank")))
    missing = resolve.missing_parent_summary(occ, raw, source)
    metrics = issues.agg(F.count_if(F.col("severity") == "error").alias("rejected")).crossJoin(profile.duplicate_keys(source, ["symbol"])[1])
    metrics = metrics.crossJoin(resolve.orphans(raw, occ, "occurrence_id").agg(F.count("*").alias("orphans"))).crossJoin(source.agg(F.count("*").alias("rows")))
    validate.gate(metrics, {"rejected": "rejected = 0", "duplicates": "duplicate_keys = 0", "orphans": "orphans = 0", "rows": "rows > 0"})

    cols = ["name_raw", "rank", "status", "name"]
    before = source.limit(0).withColumns({"is_current": F.lit(True), "import_id": F.lit(0).cast("long")}) if current is None else current
    symbols = written(snapshot.snapshot_upsert(before.select("symbol", *cols, "is_current", "import_id"), source, ["symbol"], cols, import_id), "symbols")
    coded, remarks = dictionary_encode(raw, ["remark_sha"])
    traits, distribution = facts_.attribute_facts(coded, occ, symbols, remarks)
    place = classify_place(F.col("value_raw"))
    distribution = distribution.select("symbol", "kind", F.col("value_raw").alias("place_raw"), place.alias("p"), "remark_sha").select("symbol", "kind", "place_raw", "p.*", "remark_sha")
    distribution, collapsed = snapshot.replace_all(distribution, ["symbol", "kind", "place_raw"], [F.coalesce("remark_sha", F.lit(""))])
    labelled = written(facts_.label_facts(traits, seeds["trait_type"].select("type_uri", "key", "value_kind"), seeds["code_label"].select("code", "type_uri", "label", "confidence")), "facts")
    links = resolve.link_by_precedence(symbols.where("is_current").select("symbol", F.col("name_raw").alias("name"), "rank"), ext_ids, item_links, taxa)
    out = {
        "symbol_taxon": symbols, "fact": labelled, "remark": remarks, "distribution": distribution, "collapsed": collapsed, "symbol_link": links, "missing_symbols": missing, "issues": issues,
        "label_coverage": profile.label_coverage(labelled), "fact_groups": profile.group_counts(labelled, ["key", "value_kind"]), "link_report": profile.link_report(links),
    }
    publish(out, target, import_id)
    return out


# the key of each kind of supplemental table, and its ids that refer to taxa
SUPPLEMENT = {"ipni": (["ipni_id", "wfo_id"], ["wfo_id"]), "deprecated": (["wfo_id"], ["wfo_id"]), "deduplicated": (["wfo_id"], ["wfo_id", "replacement_wfo_id"])}


def supplement_stats(table: DataFrame, kind: str) -> DataFrame:
    """One row of counts over a resolved supplemental table."""
    found = F.col("resolved_wfo_id").isNotNull()
    if kind == "ipni":
        each = {"mappings": F.count("*"), "ipni_ids": F.countDistinct("ipni_id"), "wfo_ids": F.countDistinct("wfo_id"), "ids_resolved": F.countDistinct(F.when(found, F.col("wfo_id"))), "ids_not_found": F.countDistinct(F.when(~found, F.col("wfo_id")))}
    elif kind == "deprecated":
        each = {"names": F.count("*"), "ids": F.countDistinct("wfo_id"), "ids_in_backbone": F.count_if(found), "ids_absent": F.count_if(~found)}
    else:
        new = F.col("resolved_replacement_wfo_id").isNotNull()
        each = {"mappings": F.count("*"), "replacements_resolved": F.count_if(new), "replacements_unresolved": F.count_if(~new), "ids_in_backbone": F.count_if(found), "self_references": F.count_if(F.col("wfo_id") == F.col("replacement_wfo_id"))}
    return table.agg(*[c.alias(n) for n, c in each.items()])


def import_supplemental(spark: SparkSession, path: str, kind: str, current: DataFrame | None, taxa: DataFrame, target: str, import_id: int) -> dict[str, DataFrame]:
    """Read a supplemental file of a ``kind``, merge it into the table of the import before, resolve and publish it.

    Rows of a known key are replaced and stamped, others added; rows that the file no longer has stay as they were.
    Every id column has resolved_<id>, the id if a current taxon bears it, brought up to date for all rows. An empty
    file, a repeated key, and replacements that reach a cycle, also through rows of earlier imports, or are longer than
    resolution follows, refuse the import. Extra columns of ``current`` are dropped.
    """
    key, ids = SUPPLEMENT[kind]
    rows, issues = delimited.scan_supplemental_csv(spark, path, kind)
    stage = written(rows.withColumn("import_id", F.lit(import_id).cast("long")), "supplement")
    metrics = profile.duplicate_keys(stage, key)[1].crossJoin(stage.agg(F.count("*").alias("rows")))
    validate.gate(metrics, {"rows": "rows > 0", "duplicates": "duplicate_keys = 0"})
    table = stage
    if current is not None:
        table = current.select(*stage.columns).join(stage.select(*key), key, "left_anti").select(*stage.columns).unionByName(stage)
    live = taxa.where("is_current") if "is_current" in taxa.columns else taxa
    table = written(referenced(table, {c: f"resolved_{c}" for c in ids}, live.select("taxon_id")), "supplemental")
    if kind == "deduplicated":
        edges = table.select(F.col("wfo_id").alias("old_id"), F.col("replacement_wfo_id").alias("new_id"))
        validate.gate(resolve.validate_chain_graph(edges), {"cycles": "cycles = 0", "depth": "too_long = 0"})
    out = {kind: table, "issues": issues, "stats": supplement_stats(table, kind)}
    publish(out, target, import_id)
    return out
