from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.operators import dedup, facts, resolve, search, snapshot, validate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chain_boundaries(spark):
    edges = [("a", "b"), ("b", "c"), ("s", "s"), ("x", "y"), ("y", "x"), ("t", "x")]
    edges += [(f"p{i:02}", f"p{i + 1:02}") for i in range(64)] + [(f"q{i:02}", f"q{i + 1:02}") for i in range(65)]
    e = spark.createDataFrame(edges, "old_id string, new_id string")
    current = spark.createDataFrame([("a",), ("c",), ("p64",), ("q65",)], "taxon_id string")
    ids = spark.createDataFrame([(i,) for i in ("a", "b", "c", "s", "x", "t", "p00", "q00", "q01", "lost", None)], "id string")
    got = {r.id: (r.resolved, r.status) for r in resolve.resolve_chain(ids, e, current).collect()}
    assert got == {
        "a": ("c", "Resolved"), "b": ("c", "Resolved"), "c": ("c", "Resolved"), "s": ("s", "Cycle"), "x": ("x", "Cycle"), "t": ("x", "Cycle"),
        "p00": ("p64", "Resolved"), "q00": ("q64", "DepthLimit"), "q01": ("q65", "Resolved"), "lost": ("lost", "NotFound"),
    }
    assert rows(resolve.validate_chain_graph(e)) == [(4, 1)]


def test_snapshot_is_idempotent_and_retires(spark):
    old = spark.createDataFrame([(1, "a", True, 1), (2, "b", True, 1), (3, "c", False, 1), (None, "n", True, 1)], "k int, v string, is_current boolean, import_id long")
    new = spark.createDataFrame([(1, "a"), (3, "c"), (4, None), (None, "m")], "k int, v string")
    assert rows(snapshot.counts(snapshot.diff(old, new, ["k"], ["v"]))) == [("insert", 1), ("reactivate", 1), ("retire", 1), ("same", 1), ("update", 1)]
    once = snapshot.change_only_upsert(old, new, ["k"], ["v"], 2)
    again = snapshot.change_only_upsert(once, new, ["k"], ["v"], 3)
    assert rows(once) == rows(again)
    assert {(r.k, r.is_current, r.import_id) for r in once.collect()} == {(1, True, 1), (2, False, 2), (3, True, 2), (4, True, 2), (None, True, 2)}


def test_children_of_unfetched_parents_stay(spark):
    cur = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "d"), (3, "x")], "p int, v string")
    out, n = snapshot.replace_children(cur, new, spark.createDataFrame([(1,)], "p int"), ["p"], ["p", "v"])
    assert rows(out) == [(1, "b"), (1, "d"), (2, "c")]
    assert rows(n) == [("delete", 1), ("insert", 1)]


def test_gate_and_shrink(spark):
    m = spark.createDataFrame([(0, 5)], "rejected int, n int")
    assert validate.gate(m, {"clean": "rejected = 0"})["n"] == 5
    with pytest.raises(validate.GateClosed):
        validate.gate(m, {"few": "n > 9"})
    validate.shrink_guard(5, 10)
    validate.shrink_guard(1, 10, allow=True)
    for n in (0, 4):
        with pytest.raises(validate.GateClosed):
            validate.shrink_guard(n, 10)


def test_split_valid_keeps_all_issues_of_a_rejected_row(spark):
    df = spark.createDataFrame([("1", "ok"), ("", "bad\x00"), ("3�", "t"), ("4", "t�")], "id string, name string")
    good, issues = validate.split_valid(df, ["id"], ["id"], "f", "id")
    assert rows(good.select("id")) == [("1",), ("4",)]
    assert rows(issues.select("severity", "kind", "field")) == [("error", "nul", "name"), ("error", "replacement_character", "id"), ("error", "required", "id"), ("warning", "replacement_character", "name")]


def test_link_precedence(spark):
    symbols = spark.createDataFrame([("A", "Acer rubrum L.", "species"), ("B", "Acer nigrum L.", "species"), ("C", "Acer saccharum L.", "species"), ("D", "Acer album L.", "species"), ("E", None, None)], "symbol string, name string, rank string")
    ext = spark.createDataFrame([("Q1", "A"), ("Q2", "B"), ("Q3", "B")], "qid string, value string")
    links = spark.createDataFrame([("Q1", "t9"), ("Q2", "t1"), ("Q3", "t2")], "qid string, taxon string")
    taxa = spark.createDataFrame([("t1", "Acer nigrum"), ("t2", "x"), ("t9", "y"), ("t3", "ACER saccharum"), ("t4", "Acer album"), ("t5", "Acer album")], "taxon_id string, name string").withColumn("rank", F.lit("species")).withColumn("is_current", F.lit(True))
    got = {r.symbol: (r.taxon, r.method, r.status) for r in resolve.link_by_precedence(symbols, ext, links, taxa).collect()}
    assert got == {"A": ("t9", "external", "Linked"), "B": (None, "external", "Conflict"), "C": ("t3", "name", "Linked"), "D": (None, "name", "Ambiguous"), "E": (None, "name", "NotFound")}


def test_label_override_replaces_even_without_label(spark):
    f = spark.createDataFrame([("s", "u1", "c", "c"), ("s", "u2", "c", "c"), ("s", "u3", "9", "9"), ("s", "u1", "z", "z")], "symbol string, type_uri string, code string, value_raw string")
    types = spark.createDataFrame([("u1", "k1", "coded"), ("u2", "k2", "coded"), ("u3", "k3", "numeric")], "type_uri string, key string, value_kind string")
    labels = spark.createDataFrame([("c", None, "General", "verified"), ("c", "u2", None, "unresolved")], "code string, type_uri string, label string, confidence string")
    assert rows(facts.label_facts(f, types, labels).select("key", "label", "display")) == [("k1", "General", "General"), ("k1", None, "z (unmapped)"), ("k2", None, "c (unresolved)"), ("k3", None, "9")]


def test_compare_modes(spark):
    ours = spark.createDataFrame(
        [("s", "a", "Tall (big)", "verified", None, None), ("s", "set", "Tree", "verified", None, None), ("s", "set", "Shrub", "verified", None, None), ("s", "num", None, None, 3.0, None), ("s", "num", None, None, 5.0, None), ("s", "fl", "Fire: Yes", "verified", None, None), ("s", "un", None, None, None, None), ("s", "sh", "Low", "verified", None, None)],
        "symbol string, key string, label string, confidence string, numeric double, statistic string",
    ).withColumn("present", F.lit(True)).withColumn("numeric", F.col("numeric").cast("decimal(38,15)"))
    theirs = spark.createDataFrame([("s", "F1", "tall"), ("s", "F2", "shrub"), ("s", "F2", "tree"), ("s", "F3", "3"), ("s", "F4", "5.0000001"), ("s", "F5", "4"), ("s", "Fire", "yes"), ("s", "F7", "x"), ("s", "F8", "x"), ("s", "F9", "Low")], "symbol string, field string, value string")
    mapping = spark.createDataFrame([("f1", "a", "Label"), ("F2", "set", "Set"), ("F3", "num", "Min"), ("F4", "num", "Max"), ("F5", "num", "Only"), ("Fire", "fl", "Flag"), ("F7", "un", "Label"), ("F8", "none", "Label"), ("F9", "sh", "Shade")], "field string, key string, mode string").withColumn("statistic", F.lit(None).cast("string"))
    got = {r.field: r.outcome for r in facts.compare_facts(ours, theirs, mapping).collect()}
    assert got == {"f1": "Agree", "F2": "Agree", "F3": "Agree", "F4": "Agree", "F5": "Disagree", "Fire": "Agree", "F7": "Unmapped", "F8": "Missing", "F9": "Unresolved"}


def test_first_per_key_and_examples(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y")], "k string, o int, v string")
    assert rows(dedup.first_per_key(df, ["k"], [F.col("o")])) == [("a", 1, "x"), ("b", 3, "y")]
    assert rows(validate.count_with_examples(df, ["k"], F.col("o"), 1).select("k", "n", "examples")) == [("a", 2, "1"), ("b", 1, "3")]


@pytest.fixture(scope="module")
def plants(spark):
    taxa = spark.createDataFrame(
        [(1, "Acer", "Acer", "genus", "Accepted", None), (2, "Acer rubrum", "Acer", "species", "Accepted", None), (3, "Rufacer carolinianum", "Rufacer", "species", "Synonym", 2), (4, "Hosta", "Hosta", "genus", "Accepted", None), (5, "Hostana", "Hosta", "species", "Synonym", 4), (6, "Lost acer", "Lost", "species", "Unchecked", None)],
        "taxon_id int, name string, genus string, rank string, status string, accepted_id int",
    ).withColumn("is_current", F.lit(True))
    names = spark.createDataFrame([("Q2", "en", "red maple"), ("Q2", "en-gb", "maple"), ("Q2", "fr", "érable"), ("Q4", "en", "plantain-lily")], "qid string, language string, name string")
    names = names.withColumn("normalized", F.lower("name")).withColumn("compact", F.translate(F.lower("name"), " -", ""))
    links = spark.createDataFrame([("Q2", 3, 2), ("Q4", 4, None)], "qid string, taxon int, accepted int")
    return taxa, names, links


@pytest.mark.parametrize(("few", "term", "want"), [
    (few, *case) for few in (True, False) for case in [
        ("acer", [(1, 10, "scientificName"), (2, 20, "scientificName"), (6, 30, "scientificName")]),
        ("maple", [(2, 10, "commonName")]),
        ("plantain lily", [(4, 15, "commonName")]),
        ("hosta", [(4, 10, "scientificName")]),
        ("%_", []),
        ("x", []),
        ("rufacer", [(2, 20, "synonym")]),
    ]
])
def test_search(spark, plants, monkeypatch, few, term, want):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1000 if few else 0)
    out = search.search_names(*plants, spark.createDataFrame([(f" {term} ",)], "query string"))
    assert [(r.taxon_id, r.tier, r.matched_on) for r in out.orderBy("position").collect()] == want


def test_compare_sql_of_registered_queries_is_complete():
    from quernstone.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
