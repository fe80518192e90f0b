from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone.plans import refreshes as R
from quernstone.sinks import buckets as B


def claims(prop, *values):
    return {prop: [{"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": v}}} for v in values]}


def entity(qid, rev, label, names=(), wfo=(), redirect=None):
    told = [json.dumps({"language": "en", "text": n}) for n in names]
    out = {"id": qid, "lastrevid": rev, "labels": {"en": {"value": label}}, "claims": claims("P1843", *told) | claims("P7715", *wfo)}
    return out | ({"redirects": {"from": redirect, "to": qid}} if redirect else {})


def put(folder, **docs):
    folder.mkdir(parents=True)
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(json.dumps(doc))
    return str(folder)


def numbers(report):
    return {r.metric: r.n for r in report.collect()}


def test_details(spark, tmp_path):
    target = str(tmp_path / "store")
    wanted = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",), ("Q4",), (None,), ("Q1",)], "qid string")
    links = spark.createDataFrame([("Q1", "a", True), ("Q1", "old", False), ("Q2", "b", True)], "qid string, taxon_id_raw string, is_current boolean")
    doc = {"Q1": entity("Q1", 1, "one", ["Ein"], ["a"]), "Q2": entity("Q2", 1, "two", ["Zwei"], ["c"]), "Q3": {"id": "Q3", "missing": ""}, "Q9": entity("Q9", 1, "not asked for")}
    out = R.import_details(spark, put(tmp_path / "1", a={"entities": doc}), target, wanted, links, 1, n=8)
    got = numbers(out["report"])
    assert (got["items_checked"], got["items_missing"], got["items_fetched"], got["items_inserted"], got["names_inserted"], got["taxon_id_mismatches"]) == (4, 1, 2, 2, 2, 1)
    assert {(r.kind, r.key) for r in out["issues"].collect()} == {("missing", "Q3"), ("absent", "Q4"), ("taxon_ids", "Q2")}

    # the same entities again: nothing is due, no version is made
    first = B.latest(spark, target)
    again = R.import_details(spark, str(tmp_path / "1"), target, wanted, links, 2)
    assert B.latest(spark, target).name == first.name and numbers(again["report"])["items_fetched"] == 0

    # Q2 redirects to Q5, Q1 is missing now, Q4 comes for the first time; full takes what has the same revision too
    doc = {"Q1": {"id": "Q1", "missing": ""}, "Q2": entity("Q5", 7, "five", ["Fünf"], redirect="Q2"), "Q4": entity("Q4", 1, "four")}
    out = R.import_details(spark, put(tmp_path / "2", a={"entities": doc}), target, wanted, links, 3, batches=3)
    got = numbers(out["report"])
    assert (got["items_redirected"], got["items_inserted"], got["items_updated"], got["items_retired"], got["names_inserted"], got["names_deleted"]) == (1, 2, 0, 1, 1, 0)
    at = B.latest(spark, target)
    assert {(r.qid, r.label, r.is_current, r.import_id) for r in B.table(spark, at, "item").collect()} == {("Q1", "one", True, 1), ("Q2", "two", False, 3), ("Q4", "four", True, 3), ("Q5", "five", True, 3)}
    doc = {"Q4": entity("Q4", 1, "changed"), "Q5": entity("Q5", 7, "five", ["Cinq"])}
    path = put(tmp_path / "3", a={"entities": doc})
    assert numbers(R.import_details(spark, path, target, wanted, links, 4)["report"])["items_fetched"] == 0
    got = numbers(R.import_details(spark, path, target, wanted, links, 5, full=True)["report"])
    assert (got["items_fetched"], got["items_updated"], got["names_inserted"], got["names_deleted"], got["items_inserted"]) == (2, 1, 1, 1, 0)


def test_details_resume(spark, tmp_path, monkeypatch):
    """A run that breaks off in its second batch keeps the first; the next one takes in only the rest."""
    target, ids = str(tmp_path / "store"), [f"Q{i}" for i in range(1, 30)]
    wanted, links = spark.createDataFrame([(q,) for q in ids], "qid string"), spark.createDataFrame([], "qid string, taxon_id_raw string")
    path = put(tmp_path / "in", a={"entities": {q: entity(q, 3, q) for q in ids}})
    merge, calls = R.merge_entities, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("gone")
        return merge(*args)

    monkeypatch.setattr(R, "merge_entities", breaks)
    with pytest.raises(OSError):
        R.import_details(spark, path, target, wanted, links, 1, batches=2, n=8)
    had = B.table(spark, B.latest(spark, target), "item").count()
    assert 0 < had < len(ids)
    got = numbers(R.import_details(spark, path, target, wanted, links, 2, batches=2)["report"])
    assert got["items_fetched"] == got["items_inserted"] == len(ids) - had
    assert {r.import_id for r in B.table(spark, B.latest(spark, target), "item").collect()} == {1, 2}


def test_details_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "qid string, taxon_id_raw string")
    out = R.import_details(spark, put(tmp_path / "in", a={"entities": {}}), str(tmp_path / "store"), none.select("qid"), none, 1)
    assert set(numbers(out["report"]).values()) == {0} and out["issues"].isEmpty() and B.latest(spark, str(tmp_path / "store")) is None


def test_articles(spark, tmp_path):
    items = spark.createDataFrame([("Q1", "Acer", True), ("Q2", "Acer", True), ("Q3", "Bad|title", True), ("Q4", "Gone", True), ("Q5", None, True), ("Q6", "Old", False), ("Q7", "Moved", True)], "qid string, title string, is_current boolean")

    def page(title, item, rev, **more):
        return {"title": title, "pageid": 5, "lastrevid": rev, "pageprops": {"wikibase_item": item, "wikibase-shortdesc": f"about {title}"}, **more}

    def pages(*found, **edges):
        return {"query": {"pages": list(found), **edges}}

    hop = {"redirects": [{"from": "Moved", "to": "New place"}]}
    info = put(tmp_path / "i1", a=pages(page("Acer", "Q2", 1), page("New place", "Q7", 4), {"title": "Gone", "missing": True}, **hop))
    leads = put(tmp_path / "l1", a=pages(page("Acer", "Q2", 1, extract="Maples."), page("New place", "Q7", 5, extract="Text."), **hop))
    one = R.import_articles(spark, info, leads, items, None, None, str(tmp_path / "out"), 1)
    row = {r.title: r for r in one["article"].collect()}
    assert {t: r.status for t, r in row.items()} == {"Acer": "Ok", "Bad|title": "Missing", "Gone": "Missing", "Moved": "Ok"}
    # the revision is that of the lead
    assert (row["Moved"].page_title, row["Moved"].rev, row["Moved"].url[-9:], row["Acer"].short_description) == ("New place", 5, "New_place", "about Acer")
    got = numbers(one["report"])
    assert (got["titles_selected"], got["articles_inserted"], got["links_inserted"], got["missing_pages"], got["leads_fetched"], got["articles_updated"]) == (4, 4, 5, 2, 2, 4)
    assert {r.kind for r in one["issues"].where("key = 'Bad|title'").collect()} == {"title", "missing"}

    # Acer: nothing new, though the landed lead differs; Moved vanished between check and fetch; Gone is named no more
    items = items.where("qid not in ('Q1', 'Q4')").unionByName(spark.createDataFrame([("Q6", "Old", True)], items.schema)).where("not (qid = 'Q6' and not is_current)")
    info = put(tmp_path / "i2", a=pages(page("Acer", "Q2", 1), page("New place", "Q7", 9), page("Old", "Q1", 2), **hop))
    leads = put(tmp_path / "l2", a=pages(page("Acer", "Q2", 1, extract="Other."), {"title": "New place", "missing": True}, page("Old", "Q1", 2, extract="Old text."), **hop))
    two = R.import_articles(spark, info, leads, items, one["article"], one["article_link"], str(tmp_path / "out"), 2)
    now = {r.title: r for r in two["article"].collect()}
    assert (now["Acer"].lead, now["Acer"].import_id, now["Acer"].fetched_at) == ("Maples.", 1, row["Acer"].fetched_at)
    assert (now["Moved"].status, now["Moved"].lead, now["Moved"].rev, now["Moved"].url) == ("Missing", "Text.", 5, row["Moved"].url)
    assert (now["Gone"].is_current, now["Gone"].import_id, now["Old"].status) == (False, 2, "ItemMismatch")
    got = numbers(two["report"])
    assert (got["articles_inserted"], got["articles_retired"], got["links_inserted"], got["links_removed"], got["articles_updated"]) == (1, 1, 1, 2, 2)
    assert {r.status: r.n for r in two["statuses"].collect()} == {"Ok": 1, "Missing": 2, "ItemMismatch": 1}
    assert two["lengths"].first().n == 1 and two["article"].where(F.col("is_current")).count() == 4
