"""Bucketed versions and the stream of entity documents."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.sinks import buckets as B
from quernstone.sources import landed
from quernstone.streaming.landing import ingest_entities_stream, merge_entities


def files(v, name="rows"):
    return {b: sorted(os.listdir(f"{v.path}/{f}")) for b, f in v.folders[name].items()}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_small_change_rewrites_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    stage = spark.range(3000).select(F.col("id"), (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    one = B.publish_changes(spark, path, "rows", stage, "id", ["v", "w"], 1, n=64)
    assert len(one.folders["rows"]) == 64 and sum(one.rows["rows"].values()) == 3000
    before = rows_of(B.table(spark, one, "rows"))
    changed = F.col("id").isin(5, 700)
    new = stage.where("id <> 9").withColumn("v", F.when(changed, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9000, 1, "new")], "id long, v long, w string"))
    two = B.publish_changes(spark, path, "rows", new, "id", ["v", "w"], 2)
    hit = set(B.touched(spark.createDataFrame([(i,) for i in (5, 700, 9, 9000)], "id long"), "id", 64))
    assert {b for b in range(64) if one.folders["rows"][b] != two.folders["rows"][b]} == hit
    was, now = files(one), files(two)
    assert all(was[b] == now[b] for b in range(64) if b not in hit)
    got = {r.id: (r.v, r.is_current, r.import_id) for r in B.table(spark, B.latest(spark, path), "rows").collect()}
    assert len(got) == 3001 and got[5] == (-1, True, 2) and got[9] == (18, False, 2) and got[9000] == (1, True, 2) and got[6] == (12, True, 1)
    assert rows_of(B.table(spark, B.version(spark, path, one.name), "rows")) == before  # an old version reads as it was
    three = B.publish_changes(spark, path, "rows", new, "id", ["v", "w"], 3)
    assert three.folders == two.folders  # nothing changed


def test_a_failed_write_leaves_the_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    stage = spark.range(100).select("id", F.col("id").alias("v"))
    one = B.publish_changes(spark, path, "rows", stage, "id", ["v"], 1, n=4)
    broken = stage.withColumn("v", F.when(F.col("id") == 50, F.raise_error("no")).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="no"):
        B.commit(spark, path, one, {"rows": (broken, "id")}, [0, 1, 2, 3], 2)
    assert B.latest(spark, path).name == one.name and B.table(spark, B.latest(spark, path), "rows").count() == 100
    nothing = B.publish_changes(spark, path, "other", stage.limit(0), "id", ["v"], 3)
    assert B.table(spark, nothing, "other").count() == 0 and B.table(spark, nothing, "rows").count() == 100


def entity(i, rev, label, names=(), ids=(), **more):
    claims = {"P1843": [{"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"text": n, "language": "en"}}}} for n in names], "P846": [{"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": v}}} for v in ids]}
    return {"id": f"Q{i}", "lastrevid": rev, "labels": {"en": {"value": label}}, "claims": claims, **more}


def put(folder, name, entities):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"entities": entities}))


def state(spark, path):
    v = B.latest(spark, path)
    return {t: rows_of(B.table(spark, v, t).drop("import_id")) for t in v.schemas}


def test_entity_stream_in_three_batches(spark, tmp_path):
    """Three landings and a replay equal one merge of all documents; buckets that a batch does not touch keep their files."""
    land, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "seen")
    docs = [
        {f"Q{i}": entity(i, 1, f"label {i}", [f"Name {i}", "Both"], [str(i)]) for i in range(1, 40)},
        {"Q3": entity(3, 5, "newer", ["Other"], ["3", "33"]), "Q4": entity(4, 0, "older"), "Q50": entity(50, 1, "added"), "Q7": {"id": "Q7", "missing": ""}},
        {"Q8": entity(9, 2, "target", ["Nine"], redirects={"from": "Q8", "to": "Q9"}), "Q5": entity(5, 1, "label 5", ["Name 5", "Both"], ["5"])},
    ]
    seen = []
    for i, d in enumerate(docs):
        put(land, f"{i}.json", d)
        ingest_entities_stream(spark, str(land), target, mark, n=32)
        seen.append(B.latest(spark, target))
    ids = spark.createDataFrame([("Q3",), ("Q4",), ("Q50",)], "qid string")
    hit = set(B.touched(ids, "qid", 32))
    for t in ("item", "item_name", "item_external_id"):
        was, now = seen[0].folders[t], seen[1].folders[t]
        assert {b for b in was | now if was.get(b) != now.get(b)} <= hit and len(hit) < len(was)
        assert all(files(seen[0], t)[b] == files(seen[1], t)[b] for b in was if b not in hit)
    item = {r.qid: r for r in B.table(spark, seen[2], "item").collect()}
    assert item["Q3"].label == "newer" and item["Q4"].label == "label 4" and item["Q9"].label == "target" and not item["Q8"].is_current
    assert item["Q7"].is_current and item["Q5"].import_id == 0 and item["Q8"].import_id == 2
    names = {(r.qid, r.name, r.normalized) for r in B.table(spark, seen[2], "item_name").collect()}
    assert {n for q, n, _ in names if q == "Q3"} == {"Other"} and ("Q9", "Nine", "nine") in names
    # a delivered batch that comes again is not merged again
    stream = spark.read.text(f"{mark}/metadata").first()[0]
    again = landed.entity_rows(spark.read.schema(landed.ENTITIES).json(str(land / "0.json"), multiLine=True))
    assert merge_entities(spark, target, again, 0, ledger=stream) is None and B.latest(spark, target).name == seen[2].name
    assert merge_entities(spark, target, again, 9, ledger="another stream") is not None  # older revisions change nothing
    three = state(spark, target)
    single = str(tmp_path / "single")
    merge_entities(spark, single, landed.entity_rows(spark.read.schema(landed.ENTITIES).json(str(land), multiLine=True)), 1, n=32)
    assert state(spark, single) == three


def test_a_truncated_document_stops_the_stream(spark, tmp_path):
    put(tmp_path / "in", "a.json", {"Q1": entity(1, 1, "x")})
    ingest_entities_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen"), n=4)
    (tmp_path / "in" / "b.json").write_text(json.dumps({"entities": {"Q2": entity(2, 1, "y")}})[:-20])
    with pytest.raises(Exception):
        ingest_entities_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen"), n=4)
    assert B.table(spark, B.latest(spark, str(tmp_path / "out")), "item").count() == 1
