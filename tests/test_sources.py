from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators.validate import GateClosed
from quernstone.sinks import publish as P
from quernstone.sources import delimited as D
from quernstone.sources import landed as L
from quernstone.streaming.landing import ingest_landing_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def taxon(**values):
    return "\t".join(values.get(c, "") for c in D.TAXONOMY_COLUMNS)


def test_taxonomy_tsv(spark, tmp_path):
    head = "﻿" + "\t".join(D.TAXONOMY_COLUMNS)
    lines = [
        taxon(taxonID="t1", scientificName="Acer", created="2022-04-06", taxonRemarks='"a\tb\nsaid ""x"""'),
        taxon(taxonID="t2", scientificName="Acer b", created="2025-02-30"),
        taxon(taxonID="", scientificName="Acer c"),
        taxon(taxonID="t4", scientificName="Acer �"),
        taxon(taxonID="t5�", scientificName="Acer e"),
        "short\trow",
    ]
    good, issues = D.scan_taxonomy_tsv(spark, put(tmp_path / "c.tsv", "\n".join([head, *lines]) + "\n"))
    got = {r.taxonID: r for r in good.collect()}
    assert sorted(got) == ["t1", "t2", "t4"]
    assert got["t1"].taxonRemarks == 'a\tb\nsaid "x"' and str(got["t1"].created) == "2022-04-06" and got["t2"].created is None
    kinds = {(r.severity, r.kind) for r in issues.collect()}
    assert {("warning", "date"), ("error", "required"), ("warning", "replacement_character"), ("error", "replacement_character"), ("error", "record")} <= kinds
    with pytest.raises(D.BadHeader):
        D.scan_taxonomy_tsv(spark, put(tmp_path / "bad.tsv", "taxonID\tx\n"))


def test_supplemental_csv(spark, tmp_path):
    rows, issues = D.scan_supplemental_csv(spark, put(tmp_path / "i.csv", "ipni_id,wfo_id\nURN:lsid:ipni.org:names:30-1,wfo-0000000001\n"), "ipni")
    assert [tuple(r) for r in rows.collect()] == [("URN:lsid:ipni.org:names:30-1", "wfo-0000000001", "30-1")] and issues.count() == 0
    quirk = ",".join(D.SUPPLEMENTAL["deprecated"]) + "\nwfo-0000000001,wfo-0000000002,Acer,L.,species,ok\n"
    rows, issues = D.scan_supplemental_csv(spark, put(tmp_path / "d.csv", quirk), "deduplicated")
    assert rows.first().replacement_wfo_id == "wfo-0000000002" and issues.count() == 1
    with pytest.raises(GateClosed):
        D.scan_supplemental_csv(spark, put(tmp_path / "b.csv", "ipni_id,wfo_id\n1-1,nope\n"), "ipni")


def test_dwca(spark, tmp_path):
    meta = """<archive><core encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" ignoreHeaderLines="1" rowType="http://x/Taxon"><files><location>taxon.tab</location></files>
<field index="0" term="http://x/taxonID"/><field index="1" term="http://x/name"/></core></archive>"""
    put(tmp_path / "a/meta.xml", meta)
    put(tmp_path / "a/taxon.tab", 'taxonID\tname\nA\t"quoted\\n\n\nB\nC\tx\n')
    expected = {"taxa": ("http://x/Taxon", ["http://x/taxonID", "http://x/name"])}
    rows, issues = D.scan_dwca_tsv(spark, str(tmp_path / "a"), expected)["taxa"]
    assert sorted(map(tuple, rows.collect())) == [("A", '"quoted\\n'), ("C", "x")]
    assert [r.key for r in issues.collect()] == ["B"]
    with pytest.raises(D.BadHeader):
        D.scan_dwca_tsv(spark, str(tmp_path / "a"), {"taxa": ("http://x/Taxon", ["http://x/name"])})


def test_seeds_and_places(spark, tmp_path):
    ok = "code,type_uri,label,ordinal,confidence,evidence\nlo,,Low,1,verified,e\nhi,u1,,,unresolved,e\n"
    assert D.scan_seed_csv(spark, put(tmp_path / "s.csv", ok), "code_label").count() == 2
    bad = "type_uri,key,label,value_kind,notes\nu1,Bad Key,L,coded,\nu1,ok,L,nope,\n"
    with pytest.raises(GateClosed, match="duplicate"):
        D.scan_seed_csv(spark, put(tmp_path / "t.csv", bad), "trait_type")
    admin = spark.createDataFrame([("1", "Ohio", "US", "OH"), ("2", "Yukon", "CA", "12"), ("3", "Jalisco", "MX", "14")], "place_id string, name string, country_code string, admin_code string")
    lands = spark.createDataFrame([("9", "Peru", "PE"), ("8", "Guam", "GU"), ("7", "Chad", "TD")], "place_id string, name string, country_code string")
    used = spark.createDataFrame([("9",), ("8",), ("5",)], "place_id string")
    places, lost = D.build_place_dimension(admin, lands, used, ["GU"])
    assert {(r.name, r.kind) for r in places.collect()} == {("Ohio", "state"), ("Yukon", "territory"), ("Peru", "country"), ("Guam", "territory")}
    assert [r.place_id for r in lost.collect()] == ["5"]
    one = D.files_fingerprint(spark, {"a": str(tmp_path / "s.csv"), "b": str(tmp_path / "t.csv")})
    assert one == D.files_fingerprint(spark, {"b": str(tmp_path / "t.csv"), "a": str(tmp_path / "s.csv")})
    assert D.rows_fingerprint(used).first() == D.rows_fingerprint(used.orderBy("place_id")).first()


def test_sparql(spark, tmp_path):
    def b(item, value, rank):
        return {"item": {"value": item}, "wfo": {"value": value}, "rank": {"value": f"http://wikiba.se/ontology#{rank}Rank"}}

    doc = {"results": {"bindings": [b("http://www.wikidata.org/entity/Q5", "a", "Preferred"), b("http://www.wikidata.org/entity/Q6", "b", "Deprecated"), b("http://www.wikidata.org/entity/L1", "c", "Normal"), b("http://www.wikidata.org/entity/Q7", "d", "Odd")]}}
    rows, issues = L.scan_sparql_results(spark, put(tmp_path / "s.json", json.dumps(doc)))
    assert [tuple(r) for r in rows.collect()] == [("Q5", "a", "preferred")]
    assert sorted(r.kind for r in issues.collect()) == ["deprecated", "item", "rank"]
    with pytest.raises(Exception):
        L.scan_sparql_results(spark, put(tmp_path / "cut.json", json.dumps(doc)[:-9]))[0].collect()


def test_entities(spark, tmp_path):
    def claim(value, rank="normal", kind="value"):
        return {"rank": rank, "mainsnak": {"snaktype": kind, "datavalue": {"value": value}}}

    doc = {"entities": {
        "Q1": {"id": "Q1", "lastrevid": 7, "labels": {"en": {"value": "maple"}}, "sitelinks": {"enwiki": {"title": "Maple"}}, "claims": {
            "P225": [claim("second"), claim("gone", "deprecated"), claim("first", "preferred")], "P105": [claim({"numeric-id": 34740})], "P1843": [claim({"text": "maple", "language": "en"})],
            "P846": [claim("11"), claim("11"), claim(None, kind="novalue")], "P7715": [claim("wfo-1")]}},
        "Q2": {"id": "Q9", "redirects": {"from": "Q2", "to": "Q9"}, "lastrevid": 1},
        "Q3": {"id": "Q3", "missing": ""},
    }}
    out = L.scan_entities_json(spark, put(tmp_path / "e.json", json.dumps(doc)))
    item = {r.qid: r for r in out["item"].collect()}
    assert (item["Q1"].taxon_name, item["Q1"].rank_qid, item["Q1"].title, item["Q1"].last_rev_id) == ("first", "Q34740", "Maple", 7)
    assert [tuple(r) for r in out["item_name"].collect()] == [("Q1", "en", "maple")]
    assert [tuple(r) for r in out["item_external_id"].collect()] == [("Q1", "P846", "11")]
    assert [tuple(r) for r in out["redirect"].collect()] == [("Q2", "Q9")] and [r.qid for r in out["missing"].collect()] == ["Q3"]
    assert [tuple(r) for r in out["item_taxon_id"].collect()] == [("Q1", "wfo-1")]


def test_pages(spark, tmp_path):
    one = {"query": {"normalized": [{"from": "red_maple", "to": "Red maple"}, {"from": "caf%C3%A9", "to": "Café", "fromencoded": True}], "redirects": [{"from": "Red maple", "to": "Acer rubrum"}, {"from": "Loop", "to": "Loop"}],
                     "pages": [{"title": "Acer rubrum", "pageid": 1, "lastrevid": 5}, {"title": "Café", "missing": True}]}}
    two = {"query": {"pages": [{"title": "Acer rubrum", "extract": "A tree.", "pageprops": {"wikibase_item": "Q1"}}]}}
    put(tmp_path / "p/1.json", json.dumps(one))
    put(tmp_path / "p/2.json", json.dumps(two))
    req = spark.createDataFrame([("red_maple",), ("café",), ("Loop",)], "title string")
    got = {r.requested_title: r for r in L.scan_pages_json(spark, str(tmp_path / "p"), req).collect()}
    assert (got["red_maple"].title, got["red_maple"].rev, got["red_maple"].item, got["red_maple"].extract, got["red_maple"].missing) == ("Acer rubrum", 5, "Q1", "A tree.", False)
    assert got["café"].missing and got["Loop"].missing


def test_profiles_and_identifications(spark, tmp_path):
    c = [{"PlantCharacteristicName": " Height ", "PlantCharacteristicValue": "3", "CultivarName": None}, {"PlantCharacteristicName": "Height", "PlantCharacteristicValue": "4", "CultivarName": "X"}, {"PlantCharacteristicName": "", "PlantCharacteristicValue": "4"}]
    assert [tuple(r)[1:] for r in L.scan_characteristics_json(spark, put(tmp_path / "c.json", json.dumps(c))).collect()] == [("Height", "3")]
    put(tmp_path / "f/1.json", json.dumps({"Id": 5, "Symbol": "ACRU", "Durations": ["Perennial"]}))
    put(tmp_path / "f/2.json", json.dumps({"Id": 0, "Symbol": "X"}))
    assert [(r.id, r.durations, r.growth_habits) for r in L.scan_profile_json(spark, str(tmp_path / "f")).collect()] == [(5, ["Perennial"], [])]
    doc = {"results": [{"score": 0.9, "species": {"scientificName": "Acer L.", "commonNames": ["maple", " "]}, "gbif": {"id": 0}, "images": [{"organ": "leaf", "url": {"o": "https://o", "m": "http://m", "s": None}}, {"organ": "leaf", "url": {"o": "http://o"}}]}, {"score": None, "species": {"scientificName": "x"}}],
           "predictedOrgans": [{"filename": "a.jpg", "organ": "leaf", "score": 1.0}, {"filename": "b.jpg", "organ": "cat", "score": 1.0}]}
    out = L.flatten_identifications(spark, put(tmp_path / "i.json", json.dumps(doc)))
    assert [(r.name, r.common_names, r.gbif_id) for r in out["matches"].collect()] == [("Acer L.", ["maple"], None)]
    assert [(r.small, r.medium, r.original) for r in out["reference_images"].collect()] == [("https://o", "https://o", "https://o")]
    assert [r.organ for r in out["predicted_organs"].collect()] == ["leaf"]


def test_publish_runs_and_stream(spark, tmp_path):
    where = str(tmp_path / "out")
    P.publish({"rows": spark.range(3)}, where, 1)
    P.publish({"rows": spark.range(5)}, where, 2)
    assert P.published(spark, where, "rows").count() == 5
    log = str(tmp_path / "runs")
    for status in ("Running", "Succeeded"):
        P.append_run(spark, log, 1, "wfo", "full", status, "h1", 10, 1)
    P.append_run(spark, log, 2, "wfo", "full", "Running")
    P.append_run(spark, log, 3, "wfo", "full", "Failed", "h2", 10, 1)
    runs = P.runs_of(spark.read.schema(P.RUNS).parquet(log))
    assert {(r.import_id, r.status, r.rows) for r in P.mark_abandoned(runs, "wfo").collect()} == {(1, "Succeeded", 10), (2, "Abandoned", 0), (3, "Failed", 0)}
    assert P.skip_if_seen(runs, "wfo", "full", "h1") and not P.skip_if_seen(runs, "wfo", "full", "h2") and not P.skip_if_seen(runs, "wfo", "full", "h1", force=True)
    P.write_issues(spark.createDataFrame([("f", "x" * 90)], "file string, message string"), str(tmp_path / "issues"))
    assert spark.read.json(str(tmp_path / "issues")).select(F.length("message")).first()[0] == 81

    land, target, mark = str(tmp_path / "land"), str(tmp_path / "live"), str(tmp_path / "mark")
    put(tmp_path / "land/1.json", '{"qid": "Q1", "rev": 5, "v": "new"}\n{"qid": "Q2", "rev": 1, "v": "a"}\n')

    def take():
        ingest_landing_stream(spark, "qid string, rev long, v string", land, target, mark, "qid", "rev")
        return sorted(map(tuple, P.published(spark, target, "rows").select("qid", "rev", "v").collect()))

    assert take() == [("Q1", 5, "new"), ("Q2", 1, "a")]
    put(tmp_path / "land/2.json", '{"qid": "Q1", "rev": 4, "v": "old"}\n{"qid": "Q2", "rev": 2, "v": "b"}\n')
    assert take() == [("Q1", 5, "new"), ("Q2", 2, "b")]
    assert take() == [("Q1", 5, "new"), ("Q2", 2, "b")]


ARCHIVE_TABLE = '<core encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" ignoreHeaderLines="1" rowType="http://x/Taxon"><files><location>taxon.tab</location></files><field index="0" term="http://x/a"/><field index="1" term="http://x/b"/></core>'


def test_archive_descriptor_rules(spark, tmp_path):
    expected = {"taxa": ("http://x/Taxon", ["http://x/a", "http://x/b"])}
    put(tmp_path / "a/taxon.tab", "a\tb\na\tb\nshort\n\n\"q\tx\\\n")
    other = '<extension rowType="http://x/Other"><files><location>o.tab</location></files></extension>'
    put(tmp_path / "a/meta.xml", f"<archive>{ARCHIVE_TABLE}{other}</archive>")
    rows, issues = D.scan_dwca_tsv(spark, str(tmp_path / "a"), expected)["taxa"]
    assert {tuple(r) for r in rows.collect()} == {("a", "b"), ('"q', "x\\")}  # a data line may equal the header
    assert [(r.key, r.kind, r.message) for r in issues.collect()] == [("short", "width", "1")]
    assert D.ignored_tables(spark, str(tmp_path / "a"), expected) == [("o.tab", "http://x/Other")]
    for n, (was, now) in enumerate([(' linesTerminatedBy="\\n"', ""), ('fieldsTerminatedBy="\\t"', 'fieldsTerminatedBy=","'), ('encoding="UTF-8"', 'encoding="UTF-8" fieldsEnclosedBy="&quot;"'), ('index="1"', 'index="2"'), ("taxon.tab", "../taxon.tab")]):
        put(tmp_path / f"b{n}/taxon.tab", "a\tb\n")
        put(tmp_path / f"b{n}/meta.xml", f"<archive>{ARCHIVE_TABLE.replace(was, now)}</archive>")
        with pytest.raises(D.BadHeader):
            D.scan_dwca_tsv(spark, str(tmp_path / f"b{n}"), expected)


def test_supplemental_refuses_bad_text(spark, tmp_path):
    for n, row in enumerate(["1-1,wfo-1\x00", "1-1,wfo-1 ", "urn:lsid:ipni.org:names: ,wfo-1", "1�,wfo-1", "1-1,wfo-"]):
        with pytest.raises(GateClosed):
            D.scan_supplemental_csv(spark, put(tmp_path / f"{n}.csv", f"ipni_id,wfo_id\n{row}\n"), "ipni")
    path = tmp_path / "raw.csv"
    path.write_bytes(b"ipni_id,wfo_id\n1\xff,wfo-1\n")
    with pytest.raises(GateClosed):
        D.scan_supplemental_csv(spark, str(path), "ipni")


def test_seed_errors_name_their_record(spark, tmp_path):
    head = "type_uri,key,label,value_kind,notes\n"
    for row, said in [("u:2,k1,L,coded,\n", "duplicate key"), ("http://eol.org/schema/terms/Present,k2,L,coded,\n", "distribution types are not traits"), ("u:2,k2,L,coded\n", "width")]:
        with pytest.raises(GateClosed, match=said) as e:
            D.scan_seed_csv(spark, put(tmp_path / f"{said}.csv", head + "u:1,k1,L,coded,\n" + row), "trait_type")
        assert ".csv:3" in str(e.value)


def test_entities_without_a_qid_are_issues(spark, tmp_path):
    got = L.scan_entities_json(spark, put(tmp_path / "e.json", json.dumps({"entities": {"L1": {"id": "L1"}, "Q1": {"id": "Q1"}}})))
    assert [r.message for r in got["issues"].collect()] == ["L1"] and [r.qid for r in got["item"].collect()] == ["Q1"]
