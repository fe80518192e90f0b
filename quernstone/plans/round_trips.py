"""Queries of sources, sinks, gates and the landing stream: given tables are written out in the shared folder in the
formats that the sources read, and read back through them. Only rows make the way; documents of landed JSON hold a
bounded number of them each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import facts, validate
from quernstone.plans import imports, refreshes
from quernstone.plans.imports import ARCHIVE
from quernstone.plans.queries import query
from quernstone.session import scratch_dir, table
from quernstone.sinks import buckets
from quernstone.sinks import publish as sinks
from quernstone.sources import delimited, landed
from quernstone.sources.fingerprint import tree_hashes
from quernstone.streaming.landing import ingest_entities_stream, ingest_landing_stream

PER_DOCUMENT = 500  # rows in a landed document


def place(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def lots(rows: DataFrame, number) -> DataFrame:
    """``rows`` dealt by their documents, PER_DOCUMENT rows by ``number`` each: they move as they are, before documents
    are made of them, so no task holds more than its share. Few bytes may be many files, so the tasks are not coalesced."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("lot", F.floor(number / PER_DOCUMENT).cast("long")).repartition(n, "lot")


def documents(rows: DataFrame, value, path: str) -> str:
    """Write ``value``, an aggregate over the rows of a lot, as one JSON document a file. ``rows`` come from :func:`lots`.

    The files lie in one folder, which is listed at once however many they are."""
    rows.groupBy("lot").agg(F.to_json(value).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def in_parts(rows: DataFrame, key: str, header: str, path: str) -> str:
    """Write the one text column of ``rows`` beside ``key`` in its order, after a header line, as one file in parts: the
    files below ``path`` one after the other in order of their paths. No task has more than a range of the keys."""
    spark = rows.sparkSession
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/part=0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, key).sortWithinPartitions(key).drop(key).write.text(f"{path}/part=1")
    return path


def _taxonomy(s, d):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, ' "x"').when(k % 3 == 1, "\ty").otherwise("\nz")
    given = {"taxonID": F.concat(F.lit("wfo-"), F.lpad(k.cast("string"), 10, "0")), "scientificName": F.when(k % 10 != 0, F.concat("p_name", tail)), "genus": F.col("p_type"), "created": F.concat(F.lit("2020-01-0"), (k % 9).cast("string"))}
    return table(s, d, "part").select("p_partkey", *[given.get(c, F.lit(None).cast("string")).alias(c) for c in delimited.TAXONOMY_COLUMNS])


# Names hold quotes, tabs and line feeds; one date in nine is no date
@query("taxonomy_round_trip", r"""SELECT 'wfo-' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS "taxonID", p_name || CASE p_partkey % 3 WHEN 0 THEN ' "x"' WHEN 1 THEN chr(9) || 'y' ELSE chr(10) || 'z' END AS name,
CASE WHEN p_partkey % 9 <> 0 THEN '2020-01-0' || (p_partkey % 9) END AS created, p_type AS genus FROM part WHERE p_partkey % 10 <> 0""")
def _(s, d):
    rows = _taxonomy(s, d).drop("p_partkey")
    path = place(s)
    rows.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    good, _ = delimited.scan_taxonomy_tsv(s, path)
    return good.select("taxonID", F.col("scientificName").alias("name"), F.col("created").cast("string").alias("created"), "genus")


# A snapshot is one file, here in parts, and an issue tells the line at which its record begins; names of every third record
# hold a line feed
@query("taxonomy_issues", """WITH r AS (SELECT p_partkey AS k, 1 + row_number() OVER (ORDER BY p_partkey) + coalesce(sum(CASE WHEN p_partkey % 3 = 2 AND p_partkey % 10 <> 0 THEN 1 ELSE 0 END)
  OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM part)
SELECT 'wfo-' || lpad(CAST(k AS VARCHAR), 10, '0') AS key, CAST(line AS BIGINT) AS "row", 'error' AS severity, 'required' AS kind, 'scientificName' AS field FROM r WHERE k % 10 = 0
UNION ALL SELECT 'wfo-' || lpad(CAST(k AS VARCHAR), 10, '0'), CAST(line AS BIGINT), 'warning', 'date', 'created' FROM r WHERE k % 9 = 0""")
def _(s, d):
    path = place(s)
    line = F.to_csv(F.struct(*delimited.TAXONOMY_COLUMNS), {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": ""})
    in_parts(_taxonomy(s, d).select("p_partkey", line.alias("value")), "p_partkey", "\t".join(delimited.TAXONOMY_COLUMNS), path)
    _, issues = delimited.scan_taxonomy_tsv(s, path, parts=True)
    sinks.write_issues(issues, f"{path}-issues")
    return s.read.schema("key string, row long, severity string, kind string, field string").json(f"{path}-issues").select("key", "row", "severity", "kind", "field")


@query("supplemental_round_trip", "SELECT p_partkey || '-1' AS normalized_id, 'wfo-' || p_partkey AS wfo_id FROM part")
def _(s, d):
    path = place(s)
    rows = table(s, d, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN concat('urn:lsid:ipni.org:names:', p_partkey, '-1') ELSE concat(p_partkey, '-1') END AS ipni_id", "concat('wfo-', p_partkey) AS wfo_id")
    rows.write.csv(path, header=True)
    return delimited.scan_supplemental_csv(s, path, "ipni")[0].select("normalized_id", "wfo_id")


def _descriptor(row_type: str, terms: list[str], file: str) -> str:
    fields = "".join(f'<field index="{i}" term="{t}"/>' for i, t in enumerate(terms))
    return f'<table rowType="{row_type}" encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" fieldsEnclosedBy="" ignoreHeaderLines="1"><files><location>{file}</location></files>{fields}</table>'


def _archive_rows(s, d):
    """A file of one column without quoting, whose header is the whole header line."""
    names = [t.rsplit("/", 1)[-1] for t in ARCHIVE["occurrences"][1]]
    line = F.concat_ws("\t", F.col("o_orderkey"), F.col("o_custkey"), F.lit(""), F.concat(F.lit('"'), "o_orderpriority", F.lit("\\")))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws("\t", "o_orderkey", F.lit("short"), F.lit(""))).otherwise(line)
    return table(s, d, "orders").select("o_orderkey", line.alias("\t".join(names)))


def _archive(s, path: str) -> None:
    row_type, terms = ARCHIVE["occurrences"]
    archive = '<archive xmlns="http://rs.tdwg.org/dwc/text/">' + _descriptor(row_type, terms, "occurrence.tab") + _descriptor("http://example.org/Other", terms[:1], "other.tab") + "</archive>"
    s.createDataFrame([(archive,)], "value string").coalesce(1).write.text(f"{path}/meta.xml")


# S3: quotes and backslashes are data; every seventh line is one field too short
@query("archive_round_trip", r"""SELECT CAST(o_orderkey AS VARCHAR) AS "occurrenceID", CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS "taxonID", CASE WHEN o_orderkey % 7 <> 0 THEN '"' || o_orderpriority || '\' END AS "lifeStage", o_orderkey % 7 <> 0 AS good FROM orders""")
def _(s, d):
    path, (row_type, terms) = place(s), ARCHIVE["occurrences"]
    _archive_rows(s, d).drop("o_orderkey").write.csv(f"{path}/occurrence.tab", sep="\x01", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    _archive(s, path)
    good, issues = delimited.scan_dwca_tsv(s, path, {"occurrences": (row_type, terms)})["occurrences"]
    nothing = F.lit(None).cast("string")
    bad = issues.where("kind = 'width' and message = '3'").select(F.col("key").alias("occurrenceID"), nothing.alias("taxonID"), nothing.alias("lifeStage"), F.lit(False).alias("good"))
    return good.select("occurrenceID", "taxonID", "lifeStage", F.lit(True).alias("good")).unionByName(bad)


# S3, K2: rows and issues with the numbers of their lines in the one file of a table, which is here in parts
@query("archive_rows", """WITH r AS (SELECT o_orderkey AS k, 1 + row_number() OVER (ORDER BY o_orderkey) AS line FROM orders)
SELECT CAST(k AS VARCHAR) AS key, CAST(line AS BIGINT) AS "row", CASE WHEN k % 7 = 0 THEN 'width' ELSE 'good' END AS kind FROM r""")
def _(s, d):
    path, (row_type, terms) = place(s), ARCHIVE["occurrences"]
    rows = _archive_rows(s, d)
    in_parts(rows, "o_orderkey", rows.columns[-1], f"{path}/occurrence.tab")
    _archive(s, path)
    good, issues = delimited.scan_dwca_tsv(s, path, {"occurrences": (row_type, terms)}, "row", parts=True)["occurrences"]
    return good.select(F.col("occurrenceID").alias("key"), "row", F.lit("good").alias("kind")).unionByName(issues.select("key", "row", "kind"))


# S4, S9
@query("seed_round_trip", "SELECT 'geonames' AS scheme, CAST(s_suppkey AS VARCHAR) AS place_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'state' ELSE 'country' END AS kind, 'C' || s_nationkey AS country_code FROM supplier")
def _(s, d):
    path = place(s)
    rows = table(s, d, "supplier").selectExpr("'geonames' AS scheme", "s_suppkey AS place_id", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN 'state' ELSE 'country' END AS kind", "concat('C', s_nationkey) AS country_code", "CAST(NULL AS STRING) AS admin_code")
    rows.coalesce(1).write.csv(path, header=True)  # a seed is one reviewed file
    return delimited.scan_seed_csv(s, path, "place_label").select("scheme", "place_id", "name", "kind", "country_code")


@query("place_dimension", """SELECT CAST(s_suppkey AS VARCHAR) AS place_id, CASE WHEN s_suppkey % 3 = 0 THEN 'state' WHEN s_suppkey % 3 = 1 THEN CASE WHEN s_nationkey BETWEEN 12 AND 14 THEN 'territory' ELSE 'province' END END AS kind FROM supplier WHERE s_suppkey % 3 < 2
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_name LIKE 'A%' THEN 'territory' ELSE 'country' END FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0)""")
def _(s, d):
    admin = table(s, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS place_id", "s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' ELSE 'MX' END AS country_code", "CAST(s_nationkey AS STRING) AS admin_code")
    countries = table(s, d, "nation").selectExpr("concat('n', n_nationkey) AS place_id", "n_name AS name", "CASE WHEN n_name LIKE 'A%' THEN 'TT' ELSE 'XX' END AS country_code")
    used = table(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("concat('n', c_nationkey) AS place_id")
    return delimited.build_place_dimension(admin, countries, used, ["TT"])[0].select("place_id", "kind")


# Ranks and hosts that do not fit become issues
@query("sparql_round_trip", """SELECT 'Q' || p_partkey AS qid, 'wfo-' || p_partkey AS ext_id, CASE p_partkey % 4 WHEN 0 THEN 'preferred' ELSE 'normal' END AS statement_rank, 'good' AS kind FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 5 <> 0
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN p_partkey % 4 = 2 THEN 'deprecated' WHEN p_partkey % 5 = 0 THEN 'item' ELSE 'rank' END FROM part WHERE p_partkey % 4 >= 2 OR p_partkey % 5 = 0""")
def _(s, d):
    k = F.col("p_partkey")
    host = F.when(k % 5 == 0, "http://example.org/entity/Q").otherwise(landed.ENTITY + "Q")
    rank = F.when(k % 4 == 0, T.ONTOLOGY + "PreferredRank").when(k % 4 == 1, T.ONTOLOGY + "NormalRank").when(k % 4 == 2, T.ONTOLOGY + "DeprecatedRank").otherwise("http://example.org/NormalRank")

    def value(c):
        return F.struct(c.alias("value"))

    one = F.struct(value(F.concat(host, k.cast("string"))).alias("item"), value(F.concat(F.lit("wfo-"), k.cast("string"))).alias("wfo"), value(rank).alias("rank"))
    path = documents(lots(table(s, d, "part"), k), F.struct(F.struct(F.collect_list(one).alias("bindings")).alias("results")), place(s))
    good, issues = landed.scan_sparql_results(s, path)
    nothing = F.lit(None).cast("string")
    return good.select("qid", "ext_id", "statement_rank", F.lit("good").alias("kind")).unionByName(issues.select(nothing.alias("qid"), nothing.alias("ext_id"), nothing.alias("statement_rank"), "kind"))


# S6
@query("entities_round_trip", """SELECT 'Q' || p_partkey AS qid, p_name AS taxon_name, p_type AS label, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS title, p_partkey % 100 AS last_rev_id, CASE WHEN p_partkey % 3 = 0 THEN 'id' || p_partkey END AS external_id FROM part WHERE p_partkey % 7 <> 0""")
def _(s, d):
    k = F.col("p_partkey")

    def claim(rank, v):
        return F.struct(rank.alias("rank"), F.struct(F.lit("value").alias("snaktype"), F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))

    # the second name is preferred, so it comes first; a deprecated one never counts
    names = F.array(claim(F.lit("normal"), F.lit("other")), claim(F.lit("preferred"), F.col("p_name")), claim(F.lit("deprecated"), F.lit("old")))
    ids = F.array(claim(F.when(k % 3 == 0, "normal").otherwise("deprecated"), F.concat(F.lit("id"), k.cast("string"))))
    qid = F.concat(F.lit("Q"), k.cast("string"))
    entity = F.struct(
        qid.alias("id"), F.when(k % 7 == 0, "").alias("missing"), (k % 100).alias("lastrevid"), F.create_map(F.lit("en"), F.struct(F.col("p_type").alias("value"))).alias("labels"),
        F.when(k % 2 == 0, F.create_map(F.lit("enwiki"), F.struct(F.col("p_brand").alias("title")))).alias("sitelinks"), F.create_map(F.lit("P225"), names, F.lit(landed.EXTERNAL_IDS[0]), ids).alias("claims"),
    )
    path = documents(lots(table(s, d, "part"), k), F.struct(F.map_from_entries(F.collect_list(F.struct(qid, entity))).alias("entities")), place(s))
    got = landed.scan_entities_json(s, path)
    out = got["item"].join(got["item_external_id"].select("qid", F.col("value").alias("external_id")), "qid", "left")
    return out.select("qid", "taxon_name", "label", "title", "last_rev_id", "external_id")


# Each title is normalised and then redirected, within its response
@query("pages_round_trip", """SELECT 'a b' || p_partkey AS requested_title, 'C ' || p_partkey AS title, p_partkey % 4 = 0 AS missing, p_partkey % 50 AS rev, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS extract, true AS requestable FROM part""")
def _(s, d):
    t = F.col("p_partkey").cast("string")
    rows = lots(table(s, d, "part"), F.col("p_partkey")).select("lot", "p_partkey", "p_name", F.concat(F.lit("a b"), t).alias("asked"), F.concat(F.lit("A b"), t).alias("plain"), F.concat(F.lit("C "), t).alias("end"))

    def edge(a, b):
        return F.collect_list(F.struct(F.col(a).alias("from"), F.col(b).alias("to")))

    gone = F.col("p_partkey") % 4 == 0
    page = F.struct(F.col("end").alias("title"), gone.alias("missing"), (F.col("p_partkey") % 50).alias("lastrevid"), F.when(~gone, F.col("p_name")).alias("extract"))
    query_ = F.struct(edge("asked", "plain").alias("normalized"), edge("plain", "end").alias("redirects"), F.collect_list(page).alias("pages"))
    path = documents(rows, F.struct(query_.alias("query")), place(s))
    out = landed.scan_pages_json(s, path, rows.select(F.col("asked").alias("title")))
    return out.select("requested_title", "title", "missing", "rev", "extract", T.is_requestable_title(F.col("requested_title")).alias("requestable"))


# A title is given in percent encoding, converted, and redirected three times within its response; its extract comes
# in a continued response of its own, and one redirect in seven leads to itself
@query("pages_walk", """SELECT 'a ' || p_partkey AS requested_title, CASE WHEN p_partkey % 7 = 0 THEN 'd1 ' ELSE 'd3 ' END || p_partkey AS title, false AS missing, p_partkey % 50 AS rev, p_name AS extract FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    names = {"asked": F.concat(F.lit("a "), t), "coded": F.concat(F.lit("a%20"), t), "plain": F.concat(F.lit("B "), t), "conv": F.concat(F.lit("C "), t), **{f"d{i}": F.concat(F.lit(f"d{i} "), t) for i in (1, 2, 3)}}
    rows = lots(table(s, d, "part"), k).select("lot", "p_partkey", "p_name", *[c.alias(n) for n, c in names.items()]).withColumn("next", F.when(k % 7 == 0, F.col("d1")).otherwise(F.col("d2")))

    def edge(a, b, coded=False):
        return F.struct(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(coded).alias("fromencoded"))

    end = F.when(k % 7 == 0, F.col("d1")).otherwise(F.col("d3"))
    page = F.struct(end.alias("title"), F.lit(False).alias("missing"), (k % 50).alias("lastrevid"))
    hops = F.flatten(F.collect_list(F.array(edge("conv", "d1"), edge("d1", "next"), edge("d2", "d3"))))
    body = F.struct(F.collect_list(edge("coded", "plain", True)).alias("normalized"), F.collect_list(edge("plain", "conv")).alias("converted"), hops.alias("redirects"), F.collect_list(page).alias("pages"))
    more = F.struct(F.collect_list(F.struct(end.alias("title"), F.col("p_name").alias("extract"))).alias("pages"))
    path = place(s)
    documents(rows, F.struct(body.alias("query")), f"{path}/run=1")
    documents(rows, F.struct(more.alias("query")), f"{path}/run=2")
    return landed.scan_pages_json(s, path, rows.select(F.col("asked").alias("title"))).select("requested_title", "title", "missing", "rev", "extract")


# S8
@query("characteristics_round_trip", "SELECT 'Size' AS field, CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 2")
def _(s, d):
    one = F.struct(F.lit(" Size ").alias("PlantCharacteristicName"), F.col("p_size").cast("string").alias("PlantCharacteristicValue"), F.when(F.col("p_partkey") % 3 == 0, "Cultivar").alias("CultivarName"))
    path = documents(lots(table(s, d, "part"), F.col("p_partkey")), F.collect_list(one), place(s))
    return landed.scan_characteristics_json(s, path).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("profiles_round_trip", "SELECT p_partkey AS id, 'S' || p_partkey AS symbol, p_partkey % 2 = 0 AS has_characteristics FROM part WHERE p_partkey % 5 <> 0")
def _(s, d):
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 5 == 0, 0).otherwise(k).alias("Id"), F.concat(F.lit(" S"), k.cast("string")).alias("Symbol"), F.when(k % 2 == 0, True).alias("HasCharacteristics"))
    path = documents(lots(table(s, d, "part"), k), F.collect_list(one), place(s))
    return landed.scan_profile_json(s, path).select("id", "symbol", "has_characteristics")


# Predicted organs of files that were not sent, or of no known organ, go
@query("organs_round_trip", "SELECT CAST(p_partkey AS VARCHAR) || '.jpg' AS filename, CASE WHEN p_partkey % 3 = 0 THEN 'aerial' ELSE 'leaf' END AS organ, p_partkey AS image FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 4 <> 0")
def _(s, d):
    k = F.col("p_partkey")
    name = F.concat(k.cast("string"), F.lit(".jpg"))
    organ = F.struct(name.alias("filename"), F.when(k % 3 == 0, "aerial").when(k % 3 == 1, "leaf").otherwise("tuber").alias("organ"), F.lit(0.5).alias("score"))
    path = documents(lots(table(s, d, "part"), k), F.struct(F.collect_list(organ).alias("predictedOrgans")), place(s))
    uploads = table(s, d, "part").where("p_partkey % 4 <> 0").select(name.alias("filename"), k.alias("image"))
    return landed.flatten_identifications(s, path, uploads)["predicted_organs"].select("filename", "organ", "image")


# S10
@query("matches_round_trip", "SELECT p_name AS name, p_brand AS genus, p_partkey AS gbif_id FROM part WHERE p_partkey % 4 <> 0")
def _(s, d):
    k = F.col("p_partkey")
    species = F.struct(F.when(k % 4 != 0, F.concat("p_name", F.lit(" L."))).alias("scientificName"), F.col("p_name").alias("scientificNameWithoutAuthor"), F.struct(F.col("p_brand").alias("scientificNameWithoutAuthor")).alias("genus"))
    match = F.struct(F.lit(0.9).alias("score"), species.alias("species"), F.struct(k.alias("id")).alias("gbif"))
    path = documents(lots(table(s, d, "part"), k), F.struct(F.collect_list(match).alias("results")), place(s))
    return landed.flatten_identifications(s, path)["matches"].select("name", "genus", "gbif_id")


# K1: the second publication reads the first one
@query("published_round_trip", "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 2 = 0")
def _(s, d):
    path = place(s)
    sinks.publish({"rows": table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))}, path, 1)
    sinks.publish({"rows": sinks.published(s, path, "rows").where("o_orderkey % 2 = 0").withColumn("price", F.col("price") * 2)}, path, 1)
    return sinks.published(s, path, "rows")


# A second import changes some rows, drops some and adds some; the buckets of all others keep their files
@query("bucketed_publication", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END AS status, o_orderkey % 100 <> 5 AS is_current, CAST(CASE WHEN o_orderkey % 100 IN (3, 5, 7) THEN 2 ELSE 1 END AS BIGINT) AS import_id, true AS kept FROM orders""")
def _(s, d):
    path, k = place(s), F.col("id")
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    one = buckets.publish_changes(s, path, "orders", rows.where("id % 100 <> 7"), "id", ["status"], 1, n=64)
    two = buckets.publish_changes(s, path, "orders", rows.where("id % 100 <> 5").withColumn("status", F.when(k % 100 == 3, "X").otherwise(F.col("status"))), "id", ["status"], 2)
    changed = buckets.touched(rows.where("id % 100 in (3, 5, 7)"), "id", two.buckets)
    was, now = one.folders["orders"], two.folders["orders"]
    kept = {b for b in now if was.get(b) == now[b]} == set(now) - set(changed)
    return buckets.table(s, two, "orders").withColumn("kept", F.lit(kept))


# K2
@query("issues_round_trip", """SELECT 'pages' AS file, CAST(page_id AS VARCHAR) AS key, page_id AS "row", 'required' AS kind, 'html' AS field FROM pages WHERE page_id % 10 = 0""")
def _(s, d):
    path = place(s)
    rows = table(s, d, "pages").select("page_id", F.col("page_id").alias("n"), F.when(F.col("page_id") % 10 != 0, F.lit("text")).otherwise(F.lit("  \n")).alias("html"))
    sinks.write_issues(validate.split_valid(rows, ["html"], [], "pages", "page_id", row="n")[1], path)
    return s.read.schema("file string, key string, row long, severity string, kind string, field string, message string").json(path).select("file", "key", "row", "kind", "field")


# K3, K4
@query("run_log", """SELECT o_orderkey AS import_id, CASE o_orderkey % 3 WHEN 0 THEN 'Abandoned' WHEN 1 THEN 'Succeeded' ELSE 'Failed' END AS status, CASE o_orderkey % 3 WHEN 1 THEN o_custkey ELSE 0 END AS rows FROM orders""")
def _(s, d):
    begun = table(s, d, "orders").selectExpr("o_orderkey AS import_id", "'orders' AS source", "'full' AS kind", "'Running' AS status", "timestamp '2024-01-01' AS at", "'f' AS fingerprint", "o_custkey AS rows", "0L AS warnings")
    ended = begun.where("import_id % 3 <> 0").withColumns({"status": F.when(F.col("import_id") % 3 == 1, "Succeeded").otherwise("Failed"), "rows": F.when(F.col("import_id") % 3 == 1, F.col("rows")).otherwise(0)})
    return sinks.mark_abandoned(sinks.runs_of(begun.unionByName(ended)), "orders").select("import_id", "status", "rows")


@query("run_events", "SELECT 1 AS import_id, 'Succeeded' AS status, count(*) AS rows, true AS seen, false AS seen_other FROM orders")
def _(s, d):
    path, orders = place(s), table(s, d, "orders")
    mark = str(delimited.rows_fingerprint(orders.select("o_orderkey", "o_totalprice")).first().checksum)
    sinks.append_run(s, path, 1, "orders", "full", "Running", mark)
    sinks.append_run(s, path, 1, "orders", "full", "Succeeded", mark, orders.count())
    runs = sinks.runs_of(s.read.schema(sinks.RUNS).parquet(path))
    seen = sinks.skip_if_seen(runs, "orders", "full", mark), sinks.skip_if_seen(runs, "orders", "full", mark + "x")
    return runs.select(F.col("import_id").cast("int").alias("import_id"), "status", "rows", F.lit(seen[0]).alias("seen"), F.lit(seen[1]).alias("seen_other"))


# V4, V5
@query("gates", "SELECT count(*) AS rows, true AS shrunk FROM orders")
def _(s, d):
    orders = table(s, d, "orders")
    metrics = validate.gate(orders.agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderkey").isNull()).alias("rejected")), {"rejected": "rejected = 0", "rows": "rows > 0"})
    try:
        validate.shrink_guard(orders.where("o_orderkey % 4 = 0").count(), metrics["rows"])
        shrunk = False
    except validate.GateClosed:
        shrunk = True
    return orders.agg(F.count("*").alias("rows")).withColumn("shrunk", F.lit(shrunk))


# F7, F20
@query("source_terms", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS term, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS filled FROM part")
def _(s, d):
    k = F.col("p_partkey")
    remark = F.when(k % 3 == 0, F.concat(F.lit("Source term: "), "p_name", F.lit(". More."))).when(k % 3 == 1, F.concat(F.lit("Term: "), "p_name", F.lit("."))).otherwise(F.concat(F.lit("Source term: "), "p_name"))
    return table(s, d, "part").select("p_partkey", T.source_term(remark).alias("term"), T.empty_to_null(F.when(k % 2 == 0, F.col("p_type")).otherwise("")).alias("filled"))


# Sets of a user's events against a set given twice
@query("set_equality", """WITH o AS (SELECT user_id AS symbol, list_sort(list(DISTINCT event_type)) AS we FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT u.symbol, CASE WHEN we IS NULL THEN 'Missing' WHEN we = ['click', 'view'] THEN 'Agree' ELSE 'Disagree' END AS outcome FROM (SELECT DISTINCT user_id AS symbol FROM events) u LEFT JOIN o ON o.symbol = u.symbol""")
def _(s, d):
    e = table(s, d, "events")
    nothing = F.lit(None).cast("string")
    ours = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("symbol"), F.lit("k").alias("key"), F.concat("event_type", F.lit(" (seen)")).alias("label"), F.lit("verified").alias("confidence"), nothing.cast("decimal(38,15)").alias("numeric"), nothing.alias("statistic"))
    users = e.select(F.col("user_id").alias("symbol")).distinct()
    theirs = users.select("symbol", F.lit("KINDS").alias("field"), F.explode(F.array(*map(F.lit, ("Click", "VIEW", "click")))).alias("value"))
    mapping = s.createDataFrame([("Kinds", "k", "Set", None)], "field string, key string, mode string, statistic string")
    return facts.compare_facts(ours, theirs, mapping).select("symbol", "outcome")


# ST1: two landings, the second with greater and smaller revisions
@query("landing_stream", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 3 END AS rev, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS body FROM orders")
def _(s, d):
    path, schema = place(s), "id long, rev long, body string"
    orders = table(s, d, "orders")
    orders.selectExpr("o_orderkey AS id", "3L AS rev", "o_orderstatus AS body").write.json(f"{path}/in/one")
    ingest_landing_stream(s, schema, f"{path}/in/*", f"{path}/out", f"{path}/seen", "id", "rev")
    orders.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 5L ELSE 2L END AS rev", "'new' AS body").write.json(f"{path}/in/two")
    ingest_landing_stream(s, schema, f"{path}/in/*", f"{path}/out", f"{path}/seen", "id", "rev")
    return sinks.published(s, f"{path}/out", "rows")


# ST1, S6, C5: entity documents in two landings; the second has newer and older revisions, other names, and redirects
@query("entity_stream", """SELECT 'Q' || p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_type END AS label, p_partkey % 10 <> 4 AS is_current, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_name END AS name FROM part WHERE p_partkey > 0""")
def _(s, d):
    path, k = place(s), F.col("p_partkey")
    part = table(s, d, "part")  # Q0 is no id: an issue of S6

    def landed_as(rows, name, rev, label, common):
        told = F.to_json(F.struct(F.lit("en").alias("language"), common.alias("text")))
        claim = F.struct(F.lit("normal").alias("rank"), F.struct(F.lit("value").alias("snaktype"), F.struct(told.alias("value")).alias("datavalue")).alias("mainsnak"))
        qid = F.concat(F.lit("Q"), k.cast("string"))
        entity = F.struct(qid.alias("id"), rev.alias("lastrevid"), F.create_map(F.lit("en"), F.struct(label.alias("value"))).alias("labels"), F.create_map(F.lit("P1843"), F.array(claim)).alias("claims"))
        documents(lots(rows, k), F.struct(F.map_from_entries(F.collect_list(F.struct(qid, entity))).alias("entities")), f"{path}/in/{name}")

    def moved(rows):
        old, new = F.concat(F.lit("Q"), k.cast("string")), F.concat(F.lit("Q"), (k - 1).cast("string"))
        entity = F.struct(new.alias("id"), F.lit(0).alias("lastrevid"), F.struct(old.alias("from"), new.alias("to")).alias("redirects"))
        documents(lots(rows, k), F.struct(F.map_from_entries(F.collect_list(F.struct(old, entity))).alias("entities")), f"{path}/in/three")

    landed_as(part, "one", F.lit(3), F.col("p_type"), F.col("p_name"))
    landed_as(part.where("p_partkey % 2 = 0 or p_partkey % 3 = 0"), "two", F.when(k % 3 == 0, 5).otherwise(2), F.lit("new"), F.lit("other"))
    moved(part.where("p_partkey % 10 = 4"))
    for name in ("one", "two", "three"):
        ingest_entities_stream(s, f"{path}/in/{name}", f"{path}/out", f"{path}/seen/{name}", n=32)
    last = buckets.latest(s, f"{path}/out")
    names = buckets.table(s, last, "item_name").select("qid", "name")
    return buckets.table(s, last, "item").join(names, "qid", "left").select("qid", "label", "is_current", "name")


# Details in two imports; in the second, entities of the same revision are passed over although their
# text differs, one in seven is missing, one in ten redirects to the entity before it
@query("details_import", """SELECT 'Q' || k AS qid, CASE WHEN k % 10 = 3 THEN 'target' WHEN fresh THEN 'new' ELSE p_type END AS label, k % 10 <> 4 AS is_current,
CASE WHEN fresh OR k % 10 IN (3, 4) THEN 2 ELSE 1 END AS import_id, CASE WHEN k % 10 = 3 THEN 'target' WHEN fresh THEN 'new' ELSE p_name END AS name
FROM (SELECT p_partkey AS k, p_type, p_name, p_partkey % 3 = 0 AND p_partkey % 10 <> 4 AND (p_partkey % 7 <> 1 OR p_partkey % 10 = 3) AS fresh FROM part WHERE p_partkey > 0)""")
def _(s, d):
    path, k = place(s), F.col("p_partkey")
    part = table(s, d, "part").where("p_partkey > 0")
    asked, before = F.concat(F.lit("Q"), k.cast("string")), F.concat(F.lit("Q"), (k - 1).cast("string"))
    moves, target = k % 10 == 4, k % 10 == 3

    def landed_as(name, qid, rev, label, common, missing, redirects):
        told = F.to_json(F.struct(F.lit("en").alias("language"), common.alias("text")))
        claim = F.struct(F.lit("normal").alias("rank"), F.struct(F.lit("value").alias("snaktype"), F.struct(told.alias("value")).alias("datavalue")).alias("mainsnak"))
        entity = F.struct(
            qid.alias("id"), missing.alias("missing"), rev.alias("lastrevid"), redirects.alias("redirects"),
            F.create_map(F.lit("en"), F.struct(label.alias("value"))).alias("labels"), F.create_map(F.lit("P1843"), F.array(claim)).alias("claims"),
        )
        documents(lots(part, k), F.struct(F.map_from_entries(F.collect_list(F.struct(asked, entity))).alias("entities")), f"{path}/{name}")

    def second(same):
        return F.when(target | moves, "target").when(k % 3 == 0, "new").otherwise(same)

    edge = F.struct(asked.alias("from"), before.alias("to"))
    nothing = F.lit(None).cast("string")
    landed_as("one", asked, F.lit(1), F.col("p_type"), F.col("p_name"), nothing, F.when(F.lit(False), edge))
    absent = F.when((k % 7 == 1) & ~target & ~moves, "")
    landed_as("two", F.when(moves, before).otherwise(asked), F.when(target | moves, 9).when(k % 3 == 0, 2).otherwise(1), second("ignored"), second("ignored"), absent, F.when(moves, edge))
    wanted, links = part.select(asked.alias("qid")), s.createDataFrame([], "qid string, taxon_id_raw string")
    refreshes.import_details(s, f"{path}/one", f"{path}/out", wanted, links, 1, n=32)
    refreshes.import_details(s, f"{path}/two", f"{path}/out", wanted, links, 2, batches=2)
    last = buckets.latest(s, f"{path}/out")
    names = buckets.table(s, last, "item_name").select("qid", "name")
    return buckets.table(s, last, "item").join(names, "qid", "left").select("qid", "label", "is_current", F.col("import_id").cast("int").alias("import_id"), "name")


# Articles in two imports; titles come and go, pages vanish with their text kept, every second one has a
# new revision, and leads of the others are not taken over
@query("article_import", """WITH r AS (SELECT p_partkey AS k, p_name, p_partkey % 7 = 0 AS m1, p_partkey % 7 = 0 OR p_partkey % 17 = 0 AS m2, p_partkey % 11 = 0 AS d, p_partkey % 10 = 9 AS added,
  p_partkey % 10 = 3 AS gone, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS rev2 FROM part),
a AS (SELECT *, CASE WHEN added THEN NULL WHEN m1 THEN 'Missing' WHEN d THEN 'Disambiguation' WHEN k % 5 = 0 THEN 'ItemMismatch' WHEN k % 13 = 0 THEN 'EmptyLead' ELSE 'Ok' END AS s1,
  CASE WHEN added OR m1 OR d THEN NULL WHEN k % 13 = 0 THEN ' ' ELSE p_name END AS l1, CASE WHEN added OR m1 THEN NULL ELSE 1 END AS v1 FROM r),
b AS (SELECT *, CASE WHEN gone THEN s1 WHEN m2 THEN 'Missing' WHEN d THEN 'Disambiguation' WHEN k % 5 = 0 THEN 'ItemMismatch' WHEN rev2 = 1 AND NOT added AND k % 13 = 0 THEN 'EmptyLead' ELSE 'Ok' END AS s2,
  CASE WHEN gone OR m2 THEN l1 WHEN d THEN NULL WHEN added OR rev2 = 2 THEN 'new' ELSE l1 END AS l2, CASE WHEN gone OR m2 THEN v1 ELSE rev2 END AS v2 FROM a)
SELECT 'T ' || k AS title, s2 AS status, l2 AS lead, CAST(v2 AS BIGINT) AS rev, NOT gone AS is_current,
CASE WHEN gone OR added OR s1 IS DISTINCT FROM s2 OR l1 IS DISTINCT FROM l2 OR v1 IS DISTINCT FROM v2 THEN 2 ELSE 1 END AS import_id FROM b""")
def _(s, d):
    path, k = place(s), F.col("p_partkey")
    part = table(s, d, "part")
    title, qid = F.concat(F.lit("T "), k.cast("string")), F.concat(F.lit("Q"), k.cast("string"))

    def landed_as(name, rev, missing, lead):
        props = F.struct(F.when(k % 5 == 0, "Q0").otherwise(qid).alias("wikibase_item"), F.when(k % 11 == 0, "").alias("disambiguation"))
        page = F.struct(title.alias("title"), missing.alias("missing"), k.alias("pageid"), rev.alias("lastrevid"), props.alias("pageprops"))
        text = F.struct(title.alias("title"), missing.alias("missing"), rev.alias("lastrevid"), lead.alias("extract"))
        for kind, p in (("info", page), ("leads", text)):
            documents(lots(part, k), F.struct(F.struct(F.collect_list(p).alias("pages")).alias("query")), f"{path}/{name}/{kind}")

    landed_as("one", F.lit(1), k % 7 == 0, F.when(k % 13 == 0, " ").otherwise(F.col("p_name")))
    landed_as("two", F.when(k % 2 == 0, 2).otherwise(1), (k % 7 == 0) | (k % 17 == 0), F.lit("new"))
    items = part.select("p_partkey", qid.alias("qid"), title.alias("title"))
    one = refreshes.import_articles(s, f"{path}/one/info", f"{path}/one/leads", items.withColumn("is_current", k % 10 != 9), None, None, f"{path}/out", 1)
    two = refreshes.import_articles(s, f"{path}/two/info", f"{path}/two/leads", items.withColumn("is_current", k % 10 != 3), one["article"], one["article_link"], f"{path}/out", 2)
    return two["article"].select("title", "status", "lead", "rev", "is_current", F.col("import_id").cast("int").alias("import_id"))


# Two files of any size, each in parts, as trees over their lines
@query("file_trees", """WITH l AS (SELECT 'orders' AS role, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey || ',' || o_orderstatus AS v FROM orders
UNION ALL SELECT 'parts', row_number() OVER (ORDER BY p_partkey) - 1, p_partkey || ',' || p_name FROM part),
a AS (SELECT role, i // 1024 AS i, sha256(string_agg(sha256(v), '' ORDER BY i)) AS h, count(*) AS n, sum(strlen(v) + 1) AS b FROM l GROUP BY 1, 2),
b AS (SELECT role, i // 1024 AS i, CASE WHEN max(sum(1)) OVER (PARTITION BY role) > 1 THEN sha256(string_agg(h, '' ORDER BY a.i)) ELSE min(h) END AS h, sum(n) AS n, sum(b) AS b FROM a GROUP BY role, a.i // 1024),
c AS (SELECT role, CASE WHEN count(*) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, sum(n) AS n, sum(b) AS b FROM b GROUP BY 1)
SELECT role, CAST(n AS BIGINT) AS lines, sha256(sha256(CAST(b AS BIGINT) || ':' || h)) AS hash FROM c""")
def _(s, d):
    path = place(s)
    for role, name, key, column in (("orders", "orders", "o_orderkey", "o_orderstatus"), ("parts", "part", "p_partkey", "p_name")):
        rows = table(s, d, name).select(key, column).repartitionByRange(int(s.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
        rows.select(F.concat_ws(",", key, column).alias("value")).write.text(f"{path}/{role}")
    return tree_hashes(s, {role: f"{path}/{role}" for role in ("orders", "parts")}, parts=True)


# Replacements in two imports; the second replaces every third, adds a tenth and leaves the rest, while
# one taxon in four is retired between them
@query("supplemental_import", """SELECT 'wfo-' || k AS wfo_id, CASE WHEN k % 3 = 0 THEN 'wfo-' || (k + 20000000) ELSE 'wfo-' || (k + 10000000) END AS replacement_wfo_id,
CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'wfo-' || (k + 20000000) END AS resolved, CASE WHEN k % 3 = 0 OR k % 10 = 1 THEN 2 ELSE 1 END AS import_id FROM (SELECT p_partkey AS k FROM part)""")
def _(s, d):
    path, k = place(s), F.col("p_partkey")
    part = table(s, d, "part")

    def named(shift):
        return F.concat(F.lit("wfo-"), (k + shift).cast("string"))

    def file(rows, name, shift):
        empty = [F.lit("x").alias(c) for c in delimited.SUPPLEMENTAL["deduplicated"][2:]]
        rows.select(named(0).alias("wfo_id"), shift.alias("replacement_wfo_id"), *empty).write.csv(f"{path}/{name}", header=True)
        return f"{path}/{name}"

    taxa = part.where("p_partkey % 3 = 0").select(named(20000000).alias("taxon_id"), (k % 4 != 0).alias("is_current"))
    one = file(part.where("p_partkey % 10 <> 1"), "one", named(10000000))
    two = file(part.where("p_partkey % 3 = 0 or p_partkey % 10 = 1"), "two", F.when(k % 3 == 0, named(20000000)).otherwise(named(10000000)))
    first = imports.import_supplemental(s, one, "deduplicated", None, taxa.withColumn("is_current", F.lit(True)), f"{path}/out", 1)
    imports.import_supplemental(s, two, "deduplicated", first["deduplicated"], taxa, f"{path}/out", 2)
    out = sinks.published(s, f"{path}/out", "deduplicated")
    return out.select("wfo_id", "replacement_wfo_id", F.col("resolved_replacement_wfo_id").alias("resolved"), F.col("import_id").cast("int").alias("import_id"))
