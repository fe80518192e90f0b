"""Counts of reports that show only their first rows, and the parts that had no function."""

from __future__ import annotations

from quernstone.operators import profile


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_key_with_several_values_counts(spark):
    pairs = spark.range(60).selectExpr("id % 30 AS k", "id AS v").union(spark.createDataFrame([(99, 1), (99, 1)], "k long, v long"))
    assert profile.multi_value_keys(pairs, "k", "v").count() == 20
    assert rows(profile.multi_value_count(pairs, "k", "v")) == [(30,)]


def test_malformed_ids(spark):
    links = spark.createDataFrame([("wfo-0000000001",), *[(f"bad{i:02}",) for i in range(25)], ("bad00",)], "taxon_id_raw string")
    (n, examples), = rows(profile.malformed_ids(links))
    assert n == 26 and examples.split("|") == [f"bad{i:02}" for i in range(20)]
    assert rows(profile.malformed_ids(links.limit(0))) == [(0, "")]


def test_counts_of_items_facts_and_links(spark):
    items = spark.createDataFrame([("Q1", True), ("Q2", False)], "qid string, is_current boolean")
    ext = spark.createDataFrame([("Q1", "P1"), ("Q1", "P2"), ("Q2", "P1")], "qid string, property string")
    assert rows(profile.counts_of_current(items, ext, "property")) == [("P1", 1), ("P2", 1)]
    assert rows(profile.language_counts(items, ext.withColumnRenamed("property", "language"), 1)) == [("P1", 1)]
    taxa = spark.createDataFrame([(1, "species", "Accepted", True, None, None), (2, None, "Synonym", True, 1, 7), (3, "genus", None, False, None, None)], "taxon_id int, rank string, status string, is_current boolean, accepted_id int, parent_id int")
    facts = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "type_uri string")
    types = spark.createDataFrame([("u1", "k1")], "type_uri string, key string")
    dist = spark.createDataFrame([("Present", "wikidata", "Q5"), ("Native", "wikidata", "Q6"), ("Present", "literal", None)], "kind string, scheme string, place_id string")
    assert rows(profile.unknown_types(facts, types)) == [("u2", 1)]
    assert rows(profile.unlabelled_places(dist, dist.limit(1))) == [("wikidata", "Q6", 1)]
    assert rows(profile.fact_summary(taxa, facts, types, dist)) == sorted([
        ("rank", "species", 1), ("rank", "(none)", 1), ("status", "Accepted", 1), ("status", "Synonym", 1), ("taxa", "current", 2), ("taxa", "retired", 1),
        ("trait", "k1", 2), ("trait", "u2", 1), ("kind", "Present", 2), ("kind", "Native", 1), ("scheme", "wikidata", 2), ("scheme", "literal", 1),
    ], key=repr)
    links = spark.createDataFrame([("Linked", "name", 2, 1), ("Linked", "name", 1, 1), ("NotFound", "name", None, None)], "status string, method string, taxon int, accepted int")
    assert rows(profile.link_totals(links, taxa)) == [("Linked", "name", 2, 1, 2), ("NotFound", "name", 1, 0, 0)]
    assert rows(profile.snapshot_relations(taxa, ["accepted_id", "parent_id"])) == [("accepted_id", 1, 0), ("parent_id", 0, 1)]
    assert ("rank", None, 1) in rows(profile.snapshot_groups(taxa, ["rank"]))
