"""Steps whose work or share of a task once grew faster than their input."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from quernstone.llm import textarrays
from quernstone.operators import facts, resolve
from quernstone.plans import refreshes
from quernstone.plans.round_trips import in_parts, lots
from quernstone.session import written
from quernstone.sinks import buckets
from quernstone.sources import delimited, fingerprint, landed, records


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_large_response_is_walked_in_time(spark, tmp_path):
    n = 20000
    edges = [{"from": f"a {i}", "to": f"b {i}"} for i in range(n)]
    body = {"query": {"normalized": edges, "redirects": [{"from": f"b {i}", "to": f"c {i}"} for i in range(n)], "pages": [{"title": f"c {i}", "lastrevid": i} for i in range(n)]}}
    (tmp_path / "1.json").write_text(json.dumps(body))
    asked = spark.range(n).select(F.concat(F.lit("a "), "id").alias("title"))
    began = time.time()
    out = landed.scan_pages_json(spark, str(tmp_path), asked)
    assert out.where("not missing and replace(title, 'c ', '') = cast(rev as string) and replace(requested_title, 'a ', '') = cast(rev as string)").count() == n
    assert time.time() - began < 60
    assert "BroadcastHashJoin" not in plan_of(out)


def test_a_name_that_many_symbols_and_taxa_share(spark):
    n = 20000
    symbols = spark.range(n).select("id", F.lit("Acer rubrum").alias("name")).union(spark.createDataFrame([(1, "Quercus alba"), (-1, None), (-2, "Quercus alba")], "id long, name string"))
    symbols = symbols.select(F.col("id").alias("symbol"), "name", F.lit("species").alias("rank"))
    taxa = spark.range(n).select(F.col("id").alias("taxon_id"), F.lit("Acer rubrum").alias("name"), F.lit("species").alias("rank"), F.lit(True).alias("is_current"))
    taxa = taxa.union(spark.createDataFrame([(n, "Quercus alba", "species", True)], taxa.schema))
    began = time.time()
    out = resolve.link_by_precedence(symbols, spark.createDataFrame([], "qid long, value long"), spark.createDataFrame([], "qid long, taxon long"), taxa)
    got = {(r.status, r.n, r.taxon): r["count"] for r in out.groupBy("status", F.size("candidates").alias("n"), "taxon").count().collect()}
    assert got == {("Ambiguous", n, None): n - 1, ("Ambiguous", n + 1, None): 1, ("NotFound", 0, None): 1, ("Linked", 1, n): 1}
    assert time.time() - began < 60


def test_a_file_in_parts_is_one_file(spark, tmp_path):
    texts = ["h\tx", 'a\t"1', '2"', "b\t3", 'c\t"4', "", '5"', "d\t6"]
    (tmp_path / "one").mkdir()
    (tmp_path / "parts").mkdir()
    (tmp_path / "one/f").write_text("".join(f"{t}\n" for t in texts))
    for i, (lo, hi) in enumerate(((0, 2), (2, 5), (5, 6), (6, 8))):
        (tmp_path / f"parts/{i}").write_text("".join(f"{t}\n" for t in texts[lo:hi]))
    one, parts = str(tmp_path / "one"), str(tmp_path / "parts")

    def told(df):
        return sorted(tuple(r) for r in df.drop("file").collect())

    assert told(records.records(spark, parts, "\t", parts=True)) == told(records.records(spark, one, "\t"))
    assert told(records.numbered_lines(spark, parts, True)) == told(records.numbered_lines(spark, one))
    assert told(fingerprint.tree_hashes(spark, {"r": parts}, 2, True)) == told(fingerprint.tree_hashes(spark, {"r": one}, 2))


def test_a_snapshot_is_written_in_ranges_and_parsed_once(spark, tmp_path):
    names = delimited.TAXONOMY_COLUMNS
    given = {"taxonID": F.col("id").cast("string"), "scientificName": F.when(F.col("id") % 2 == 0, F.concat(F.lit("a\n"), F.col("id")))}
    line = F.to_csv(F.struct(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in names]), {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": ""})
    path = in_parts(spark.range(1000).repartition(3).select("id", line.alias("value")), "id", "\t".join(names), str(tmp_path / "f"))
    assert spark.read.text(f"{path}/part=1").select(F.input_file_name()).distinct().count() > 1
    good, issues = delimited.scan_taxonomy_tsv(spark, path, parts=True)
    assert good.count() == 500
    assert sorted((int(r.key), r.row) for r in issues.collect()) == [(i, 2 + i + (i + 1) // 2) for i in range(1, 1000, 2)]
    assert "from_csv" not in plan_of(good) and "from_csv" not in plan_of(issues)


def test_documents_are_dealt_before_they_are_made(spark):
    rows = lots(spark.range(5000), F.col("id"))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select("lot", F.spark_partition_id().alias("p")).distinct().count() == 10


def test_details_are_merged_and_never_broadcast(spark):
    taxa = spark.createDataFrame([("a", "A", "Accepted", None, True), ("b", "B", "Synonym", "a", True)], "taxon_id string, name string, taxonomic_status string, accepted_id string, is_current boolean")
    edges = spark.createDataFrame([("x", "b")], "old_id string, new_id string")
    out = resolve.taxon_detail(spark.createDataFrame([("x",), ("a",)], "id string"), edges, taxa, ["accepted_id"])
    assert sorted((r.id, r.name, r.accepted_id_record and r.accepted_id_record.name) for r in out.collect()) == [("a", "A", None), ("x", "B", "A")]
    assert "BroadcastHashJoin" not in plan_of(out)


def test_compared_values_move_once(spark):
    ours = spark.createDataFrame([("s", "k", "c", None, None, None, None)], "symbol string, key string, code string, label string, confidence string, numeric decimal(38,15), statistic string")
    theirs = spark.createDataFrame([("s", "F", "v")], "symbol string, field string, value string")
    mapping = spark.createDataFrame([("F", "k", "Label", None)], "field string, key string, mode string, statistic string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = facts.compare_facts(ours, theirs, mapping)
        assert [r.outcome for r in out.collect()] == ["Unmapped"]
        assert out._jdf.queryExecution().sparkPlan() and out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_blocks_are_small():
    assert textarrays.BLOCK_BYTES * 200 <= 128 << 20


def test_claims_are_looked_at_once(spark, tmp_path):
    claim = {"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": "7"}}}
    name = claim | {"mainsnak": {"snaktype": "value", "datavalue": {"value": {"language": "en", "text": "x"}}}}
    (tmp_path / "e.json").write_text(json.dumps({"entities": {"Q1": {"claims": {"P846": [claim, claim], "P961": [claim], "P1843": [name, name]}}, "Q2": {}}}))
    rows = written(landed.entity_rows(spark.read.schema(landed.ENTITIES).json(str(tmp_path / "e.json"), multiLine=True)), "rows")
    out = landed.entity_tables(rows, unique=True)
    assert sorted((r.qid, r.property, r.value) for r in out["item_external_id"].collect()) == [("Q1", "P846", "7"), ("Q1", "P961", "7")]
    assert [(r.qid, r.language, r.name) for r in out["item_name"].collect()] == [("Q1", "en", "x")] and out["item_taxon_id"].isEmpty()
    for name in ("item", "item_name", "item_external_id"):
        plan = out[name]._jdf.queryExecution().executedPlan().toString()
        assert "get_json_object" not in plan and "Exchange" not in plan and "Union" not in plan


def test_each_bucket_is_written_by_a_task_of_its_own(spark, tmp_path, monkeypatch):
    rows, tasks = spark.range(4000).select("id", F.col("id").alias("v")), []
    deal = type(rows).repartitionById

    def dealt(self, *args):
        out = deal(self, *args)
        tasks.append(out.select(buckets.BUCKET, F.spark_partition_id().alias("p")).distinct().count())
        tasks.append(out.select(F.spark_partition_id()).distinct().count())
        return out

    monkeypatch.setattr(type(rows), "repartitionById", dealt)
    at = buckets.commit(spark, str(tmp_path / "t"), None, {"a": (rows, "id"), "b": (rows.limit(0), "id")}, [1, 3, 4, 9], 1, 16)
    assert tasks[:2] == [4, 4] and sorted(at.folders["a"]) == [1, 3, 4, 9] and not at.folders["b"]
    assert sum(at.rows["a"].values()) == buckets.table(spark, at, "a").count() == rows.where(buckets.bucket_of(F.col("id"), 16).isin(1, 3, 4, 9)).count()


def test_articles_gather_no_lists_and_are_written_once(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([("Q1", "A", True), ("Q2", "A", True), ("Q3", "A", True), ("Q4", "B", True)], "qid string, title string, is_current boolean")
    pages = [{"title": "A", "lastrevid": 1, "extract": "x", "pageprops": {"wikibase_item": "Q2"}}, {"title": "B", "lastrevid": 1, "extract": "y", "pageprops": {"wikibase_item": "Q1"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"query": {"pages": pages}}))
    update, write, asked, names = refreshes.apply_article_updates, refreshes.written, [], []

    def updates(articles, info, leads, requesting):
        asked.append(requesting)
        return update(articles, info, leads, requesting)

    def told(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(refreshes, "apply_article_updates", updates)
    monkeypatch.setattr(refreshes, "written", told)
    path = str(tmp_path / "in")
    out = refreshes.import_articles(spark, path, path, items, None, None, str(tmp_path / "out"), 1)
    assert {r.title: r.status for r in out["article"].collect()} == {"A": "Ok", "B": "ItemMismatch"}
    assert [(r.title, r.qids) for r in asked[0].collect()] == [("A", ["Q2"])] and "collect_set" not in plan_of(asked[0])
    assert "article" not in names and len(names) == 6


def test_python_is_handed_only_responses_with_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"query": {"pages": [{"title": "A"}, {"title": "A"}, {"title": None}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"query": {"redirects": [{"from": "B", "to": "C"}], "pages": [{"title": "C"}]}}))
    out = landed.walks(spark.read.schema(landed.PAGES).json(str(tmp_path), multiLine=True))
    assert sorted(sorted((w.start, w.end) for w in r.walked) for r in out.collect()) == [[("A", "A")], [("B", "C"), ("C", "C")]]
    assert "greatest(" in plan_of(out)  # the helper's arguments are empty where a response has no edge
