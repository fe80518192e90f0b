from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators.validate import GateClosed
from quernstone.plans import imports as I
from quernstone.sinks.publish import published
from quernstone.sources.delimited import TAXONOMY_COLUMNS


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def taxonomy(*rows):
    return "\n".join(["\t".join(TAXONOMY_COLUMNS), *["\t".join(r.get(c, "") for c in TAXONOMY_COLUMNS) for r in rows]]) + "\n"


A = {"taxonID": "wfo-0000000001", "scientificName": "Acer", "taxonRank": "genus", "taxonomicStatus": "Accepted"}
B = {"taxonID": "wfo-0000000002", "scientificName": "Acer rubrum", "taxonRank": "species", "taxonomicStatus": "Accepted", "parentNameUsageID": "wfo-0000000001"}
C = {"taxonID": "wfo-0000000003", "scientificName": "Acer fulvum", "taxonRank": "species", "taxonomicStatus": "Synonym", "acceptedNameUsageID": "wfo-0000000002"}


def test_taxonomy_and_crosswalk(spark, tmp_path):
    target = str(tmp_path / "tax")
    I.import_taxonomy(spark, put(tmp_path / "1.tsv", taxonomy(A, B, C)), None, target, 1)
    first = published(spark, target, "taxon")
    assert {(r.taxon_id[-1], r.resolved_parent_id, r.resolved_accepted_id) for r in first.collect()} == {("1", None, None), ("2", A["taxonID"], None), ("3", None, B["taxonID"])}
    I.import_taxonomy(spark, put(tmp_path / "2.tsv", taxonomy(B, C)), first, target, 2)
    taxa = published(spark, target, "taxon")
    assert {(r.taxon_id[-1], r.is_current, r.resolved_parent_id) for r in taxa.collect()} == {("1", False, None), ("2", True, None), ("3", True, None)}
    with pytest.raises(GateClosed):
        I.import_taxonomy(spark, put(tmp_path / "3.tsv", taxonomy(B, B)), taxa, target, 3)
    assert published(spark, target, "taxon").where("import_id = 3").count() == 0

    def b(q, t, rank="Normal"):
        return {"item": {"value": f"http://www.wikidata.org/entity/{q}"}, "wfo": {"value": t}, "rank": {"value": f"http://wikiba.se/ontology#{rank}Rank"}}

    def doc(*rows):
        return json.dumps({"results": {"bindings": list(rows)}})

    edges = spark.createDataFrame([("wfo-0000000009", "wfo-0000000003")], "old_id string, new_id string")
    links = str(tmp_path / "links")
    I.import_crosswalk(spark, put(tmp_path / "s1.json", doc(b("Q1", "wfo-0000000009"), b("Q1", "wfo-0000000009", "Preferred"), b("Q2", "bad"), b("Q3", B["taxonID"]))), None, edges, taxa, links, 1)
    got = {r.qid: r for r in published(spark, links, "item_link").collect()}
    assert (got["Q1"].taxon, got["Q1"].accepted, got["Q1"].status, got["Q1"].statement_rank) == (C["taxonID"], B["taxonID"], "Resolved", "preferred")
    assert (got["Q2"].status, got["Q2"].resolved) == ("NotFound", None)
    with pytest.raises(GateClosed):
        I.import_crosswalk(spark, put(tmp_path / "s2.json", doc(b("Q3", B["taxonID"]))), published(spark, links, "item_link"), edges, taxa, links, 2)
    I.import_crosswalk(spark, put(tmp_path / "s2.json", doc(b("Q3", B["taxonID"]))), published(spark, links, "item_link"), edges, taxa, links, 2, allow_shrink=True)
    assert {(r.qid, r.is_current, r.import_id) for r in published(spark, links, "item_link").collect()} == {("Q1", False, 2), ("Q2", False, 2), ("Q3", True, 1)}


def test_traits(spark, tmp_path):
    def table(tag, name):
        row_type, terms = I.ARCHIVE[name]
        fields = "".join(f'<field index="{i}" term="{t}"/>' for i, t in enumerate(terms))
        return f'<{tag} encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" ignoreHeaderLines="1" rowType="{row_type}"><files><location>{name}.tab</location></files>{fields}</{tag}>'

    put(tmp_path / "a/meta.xml", f"<archive>{table('core', 'taxa')}{table('extension', 'occurrences')}{table('extension', 'facts')}</archive>")

    def lines(name, *rows):
        terms = I.ARCHIVE[name][1]
        put(tmp_path / f"a/{name}.tab", "\n".join("\t".join([*r, *[""] * (len(terms) - len(r))]) for r in [[t.rsplit("/", 1)[-1] for t in terms], *rows]) + "\n")

    def fact(n, occ, kind, value, remark=""):
        return [f"m{n}", occ, "", "", "", kind, value, "", "", "", "", "", "", remark]

    present = "http://eol.org/schema/terms/Present"
    lines("taxa", ["ACRU", "", "Acer rubrum L.", "Sapindaceae", "species", "accepted"], ["ACER", "", "Acer L.", "", "genus", ""])
    lines("occurrences", ["o1", "ACRU"], ["o2", "LOST"], ["o3", "ACER"])
    lines("facts", fact(1, "o1", "u:dur", "http://x/per", 'says "so"\\n'), fact(2, "o1", "u:h", "8.199999999999999"), fact(3, "o1", present, "http://g/123"), fact(4, "o3", present, "Peru"), fact(5, "o2", "u:h", "1"), fact(6, "o1", present, "http://g/123"))
    seeds = {
        "trait_type": spark.createDataFrame([("u:dur", "duration", "coded"), ("u:h", "height", "numeric")], "type_uri string, key string, value_kind string"),
        "code_label": spark.createDataFrame([("per", None, "Perennial", "verified")], "code string, type_uri string, label string, confidence string"),
    }
    taxa = spark.createDataFrame([("t1", "Acer rubrum", "species", True)], "taxon_id string, name string, rank string, is_current boolean")
    none = spark.createDataFrame([], "qid string, value string, taxon string")
    target = str(tmp_path / "traits")
    I.import_traits(spark, str(tmp_path / "a"), seeds, None, taxa, none.select("qid", "value"), none.select("qid", "taxon"), target, 1)
    read = lambda name: published(spark, target, name)
    assert {(r.key, r.display) for r in read("fact").collect()} == {("duration", "Perennial"), ("height", "8.199999999999999")}
    assert read("remark").select("text").collect()[0][0] == 'says "so"\\n'
    assert {(r.symbol, r.place_raw, r.scheme) for r in read("distribution").collect()} == {("ACRU", "http://g/123", "geonames"), ("ACER", "Peru", "literal")}
    assert {(r.symbol, r.taxon, r.status) for r in read("symbol_link").collect()} == {("ACRU", "t1", "Linked"), ("ACER", None, "NotFound")}
    assert [(r.symbol, r.occurrences, r.facts) for r in read("missing_symbols").collect()] == [("LOST", 1, 1)]
    assert read("fact").where(F.col("key") == "height").first().value_numeric is not None


def test_supplemental(spark, tmp_path):
    taxa = spark.createDataFrame([("wfo-1", True), ("wfo-2", False), ("wfo-3", True)], "taxon_id string, is_current boolean")
    target = str(tmp_path / "ipni")
    one = I.import_supplemental(spark, put(tmp_path / "1.csv", "ipni_id,wfo_id\nurn:lsid:ipni.org:names:5-1,wfo-1\n6-1,wfo-2\n7-1,wfo-1\n"), "ipni", None, taxa, target, 1)
    assert one["stats"].first().asDict() == {"mappings": 3, "ipni_ids": 3, "wfo_ids": 2, "ids_resolved": 1, "ids_not_found": 1}
    # taxon 2 is current now: rows that the new file lacks are resolved again, and keep their import
    taxa = taxa.withColumn("is_current", F.lit(True))
    I.import_supplemental(spark, put(tmp_path / "2.csv", "ipni_id,wfo_id\n7-1,wfo-1\n8-1,wfo-9\n"), "ipni", one["ipni"].withColumn("extra", F.lit(1)), taxa, target, 2)
    got = {(r.normalized_id, r.resolved_wfo_id, r.import_id) for r in published(spark, target, "ipni").collect()}
    assert got == {("5-1", "wfo-1", 1), ("6-1", "wfo-2", 1), ("7-1", "wfo-1", 2), ("8-1", None, 2)}
    with pytest.raises(GateClosed, match="duplicates"):
        I.import_supplemental(spark, put(tmp_path / "3.csv", "ipni_id,wfo_id\n7-1,wfo-1\n7-1,wfo-1\n"), "ipni", None, taxa, target, 3)
    with pytest.raises(GateClosed, match="rows"):
        I.import_supplemental(spark, put(tmp_path / "4.csv", "ipni_id,wfo_id\n"), "ipni", None, taxa, target, 4)

    head, names = "wfo_id,replacement_wfo_id,name_canonical,authors_string,rank,nomenclatural_status\n", str(tmp_path / "dedup")
    kept = I.import_supplemental(spark, put(tmp_path / "5.csv", head + "wfo-7,wfo-3,a,b,c,d\n"), "deduplicated", None, taxa, names, 1)
    assert kept["stats"].first().asDict() == {"mappings": 1, "replacements_resolved": 1, "replacements_unresolved": 0, "ids_in_backbone": 0, "self_references": 0}
    # the cycle goes through a row of the import before
    with pytest.raises(GateClosed, match="cycles"):
        I.import_supplemental(spark, put(tmp_path / "6.csv", head + "wfo-3,wfo-7,a,b,c,d\n"), "deduplicated", kept["deduplicated"], taxa, names, 2)
    assert published(spark, names, "deduplicated").count() == 1
    gone = I.import_supplemental(spark, put(tmp_path / "7.csv", "wfo_id,name_canonical,authors_string,rank,nomenclatural_status\nwfo-3,n,a,r,s\nwfo-8,n,a,r,s\n"), "deprecated", None, taxa, str(tmp_path / "gone"), 1)
    assert gone["stats"].first().asDict() == {"names": 2, "ids": 2, "ids_in_backbone": 1, "ids_absent": 1}
