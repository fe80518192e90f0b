"""Registered queries: each operator bound to the given tables, with comparison SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import articles, dedup, facts, lookup, profile, resolve, search, search_index, snapshot, validate
from quernstone.plans import bindings as B
from quernstone.session import scratch_dir, table, written
from quernstone.sources.delimited import rows_fingerprint

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


TERMS = ["red widget", "brand-17 blue", "ring", "hot", "bolt", "brand#1", "small-", "r", "ECONOMY", "%_", "gear", "brand17red"]


SEARCHED = f"""
WITH q AS (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS if len(t) > 1)}]) AS query),
qq AS (SELECT query, lower(query) AS nq, replace(replace(lower(query), ' ', ''), '-', '') AS cq FROM q),
cur AS (SELECT * FROM taxa WHERE is_current),
sci AS (SELECT qq.query, coalesce(a.taxon_id, t.taxon_id) AS target, CASE WHEN a.taxon_id IS NOT NULL THEN 'synonym' ELSE 'scientificName' END AS matched_on,
  CASE WHEN a.taxon_id IS NOT NULL THEN 1 ELSE 0 END AS source_order, t.name AS matched_text,
  CASE WHEN lower(t.name) = nq THEN 10 WHEN starts_with(lower(t.name), nq) THEN 20 WHEN contains(lower(t.name), ' ' || nq) OR contains(lower(t.name), '-' || nq) THEN 30 ELSE 40 END AS tier
  FROM cur t LEFT JOIN cur a ON t.status = 'Synonym' AND a.taxon_id = t.accepted_id JOIN qq ON contains(lower(t.name), nq) OR contains(lower(t.genus), nq)),
com AS (SELECT qq.query, coalesce(l.accepted, l.taxon) AS target, 'commonName' AS matched_on, 2 AS source_order, n.name AS matched_text,
  CASE WHEN normalized = nq THEN 10 WHEN cq <> '' AND compact = cq THEN 15 WHEN starts_with(normalized, nq) THEN 20 WHEN contains(normalized, ' ' || nq) OR contains(normalized, '-' || nq) THEN 30 WHEN contains(normalized, nq) THEN 40 ELSE 50 END AS tier
  FROM names n JOIN item_links l ON l.qid = n.qid JOIN qq ON (contains(normalized, nq) OR cq <> '' AND contains(compact, cq)) WHERE language = 'en' OR language LIKE 'en-%'),
best AS (SELECT DISTINCT ON (query, target) * FROM (SELECT * FROM sci UNION ALL SELECT * FROM com) ORDER BY query, target, tier, source_order, length(matched_text), matched_text),
ranked AS (SELECT b.query, b.target AS taxon_id, t.name, t.rank, t.status, b.matched_on, b.matched_text, b.tier, row_number() OVER (PARTITION BY b.query ORDER BY b.tier, b.matched_on = 'synonym', t.status <> 'Accepted',
  CASE t.rank WHEN 'genus' THEN 14 WHEN 'species' THEN 20 WHEN 'nothospecies' THEN 20 ELSE 24 END, t.name, t.taxon_id) AS position FROM best b JOIN cur t ON t.taxon_id = b.target),
lab AS (SELECT DISTINCT ON (r.query, r.taxon_id) r.query, r.taxon_id, n.name AS common_name FROM ranked r JOIN qq ON qq.query = r.query JOIN item_links l ON coalesce(l.accepted, l.taxon) = r.taxon_id JOIN names n ON n.qid = l.qid
  WHERE n.language = 'en' OR n.language LIKE 'en-%' ORDER BY r.query, r.taxon_id, n.language <> 'en', NOT (contains(n.normalized, qq.nq) OR qq.cq <> '' AND contains(n.compact, qq.cq)), length(n.name), n.name)
SELECT r.query, r.position, r.taxon_id, r.name, r.rank, r.status, lab.common_name, r.matched_on, r.matched_text, r.tier FROM ranked r LEFT JOIN lab ON lab.query = r.query AND lab.taxon_id = r.taxon_id WHERE position <= 20"""


@query("search_names", B.sql(SEARCHED, "taxa", "names", "item_links"))
def _(s, d):
    terms = s.createDataFrame([(t,) for t in TERMS], "query string")
    return search.search_names(B.taxa(s, d), B.names(s, d), B.item_links(s, d), terms)


# Q1: links of every fifth item are retired; their names lead nowhere and label nothing
@query("search_retired_links", B.sql(SEARCHED.replace("item_links l ON", "(SELECT * FROM item_links WHERE qid % 5 <> 0) l ON"), "taxa", "names", "item_links"))
def _(s, d):
    terms = s.createDataFrame([(t,) for t in TERMS], "query string")
    return search.search_names(B.taxa(s, d), B.names(s, d), B.item_links(s, d).withColumn("is_current", F.col("qid") % 5 != 0), terms)


# Q1, Q2: the same answers from the stored index
@query("search_index", B.sql(SEARCHED, "taxa", "names", "item_links"))
def _(s, d):
    path, terms = f"{scratch_dir(s)}/{uuid.uuid4().hex}", s.createDataFrame([(t,) for t in TERMS], "query string")
    tables = B.taxa(s, d), B.names(s, d), B.item_links(s, d)
    search_index.build_index(*tables, path)
    return search_index.search_index(s, path, *tables, terms)


@query("normalize_names", "SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) AS normalized, replace(replace(lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))), ' ', ''), '-', '') AS compact FROM customer")
def _(s, d):
    n = T.normalize_name(F.concat("c_name", F.lit("  "), "c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", n.alias("normalized")).withColumn("compact", T.compact_name(F.col("normalized")))


@query("normalize_texts", r"""SELECT doc_id, lower(replace(replace(trim(regexp_replace(strip_accents(text), '[\s\x{85}\p{Z}]+', ' ', 'g')), '’', chr(39)), '‘', chr(39))) AS normalized FROM documents""")
def _(s, d):
    return T.with_normalized(table(s, d, "documents").select("doc_id", "text"), "text", "normalized").select("doc_id", "normalized")


@query("canonical_names", """SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || split_part(p_name, ' ', 2)
  || CASE WHEN p_partkey % 3 = 2 THEN ' subsp. ' || lower(p_type) ELSE '' END AS canonical FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, '× ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS canonical FROM part WHERE p_partkey % 3 = 0""")
def _(s, d):
    p = table(s, d, "part")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "×").otherwise(""), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" L. ex Hook. f. "), F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("ssp. "), F.lower("p_type"), F.lit(" (Mill.)"))).otherwise(""))
    rank = F.when(F.col("p_partkey") % 3 == 0, "genus").when(F.col("p_partkey") % 3 == 1, "species").otherwise("subspecies")
    return p.select("p_partkey", T.canonical_name(name, rank).alias("canonical"))


@query("value_codes", r"""WITH p AS (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url, '^.*[/#]', '') ELSE url END AS code FROM pages)
SELECT page_id, code, CASE WHEN regexp_full_match(code, '[0-9]+') THEN 'geonames' WHEN regexp_full_match(code, 'Q[1-9][0-9]*') THEN 'wikidata' ELSE 'literal' END AS scheme,
CASE WHEN regexp_full_match(code, '[0-9]+') OR regexp_full_match(code, 'Q[1-9][0-9]*') THEN code END AS place_id FROM p""")
def _(s, d):
    u = table(s, d, "pages").select("page_id", T.value_code(F.col("url")).alias("code"), T.classify_place(F.col("url")).alias("p"))
    return u.select("page_id", "code", "p.scheme", "p.place_id")


@query("parse_values", r"""WITH e AS (SELECT event_id, props[7:length(props) - 1] AS raw, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE CAST(raw AS DOUBLE) * CASE WHEN event_id % 3 = 2 THEN 100 ELSE 1 END END AS number,
CASE WHEN event_id % 4 = 0 THEN NULL ELSE day END AS day FROM e""")
def _(s, d):
    raw = F.expr("substring(props, 7, length(props) - 7)")
    text = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), raw)).when(F.col("event_id") % 3 == 2, F.concat(F.lit("+"), raw, F.lit("e2"))).otherwise(raw)
    day = F.date_format("ts", "yyyy-MM-dd")
    day = F.when(F.col("event_id") % 4 == 0, F.concat(day, F.lit("\n"))).otherwise(day)
    return table(s, d, "events").select("event_id", T.parse_decimal(text).cast("double").alias("number"), T.parse_iso_date(day).cast("string").alias("day"))


@query("identifier_checks", r"""SELECT part.p_partkey, p_partkey > 0 AS qid, p_partkey % 2 = 0 AS taxon_id, p_partkey % 5 <> 0 AS symbol, p_partkey % 3 <> 0 AS snake FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    return table(s, d, "part").select(
        "p_partkey", T.is_qid(F.concat(F.lit("Q"), t)).alias("qid"), T.is_taxon_id(F.concat(F.lit("wfo-"), F.lpad(t, 10, "0"), F.when(k % 2 == 0, "").otherwise("\n"))).alias("taxon_id"),
        T.is_symbol(F.concat(F.when(k % 5 == 0, "a").otherwise("A"), t)).alias("symbol"), T.is_snake_key(F.concat(F.when(k % 3 == 0, "_").otherwise("k_"), t)).alias("snake"),
    )


@query("article_urls", "SELECT page_id, 'https://en.wikipedia.org/wiki/' || replace(replace(replace(replace(replace(url, '%', '%25'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS address FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.article_url(F.col("url")).alias("address"))


@query("rank_functions", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 14 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 20 END AS depth,
CASE p_size % 4 WHEN 0 THEN 'genus' WHEN 1 THEN 'species' WHEN 2 THEN 'infraspecific' ELSE 'other' END AS bucket, p_name AS label FROM part""")
def _(s, d):
    p = B.taxa(s, d)
    return p.select(F.col("taxon_id").alias("p_partkey"), T.rank_depth(F.col("rank")).alias("depth"), T.rank_bucket(F.col("rank")).alias("bucket"), T.comparable_label(F.concat("name", F.lit(" ("), "genus", F.lit(") "))).alias("label"))


@query("split_valid_issues", """SELECT kind, field, severity, count(*) AS n FROM (
SELECT 'required' AS kind, 'html' AS field, 'error' AS severity FROM pages WHERE page_id % 10 = 0 OR html IS NULL OR trim(html) = ''
UNION ALL SELECT 'replacement_character', 'url', 'error' FROM pages WHERE page_id % 15 = 0) GROUP BY ALL""")
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 15 == 0, F.concat("url", F.lit("�"))).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 10 != 0, F.translate("html", "�", "")).alias("html"))
    _, issues = validate.split_valid(p, ["html"], ["url"], "pages", "page_id")
    return issues.groupBy("kind", "field", "severity").agg(F.count("*").alias("n"))


@query("split_valid_rows", "SELECT page_id FROM pages WHERE page_id % 10 <> 0 AND page_id % 15 <> 0 AND html IS NOT NULL AND trim(html) <> ''")
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 15 == 0, F.concat("url", F.lit("�"))).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 10 != 0, F.col("html")).alias("html"))
    return validate.split_valid(p, ["html"], ["url"], "pages", "page_id")[0].select("page_id")


@query("check_rules", """WITH b AS (SELECT 'price' AS rule, CAST(o_orderkey AS VARCHAR) AS e FROM orders WHERE NOT o_totalprice > 5000 UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')),
r AS (SELECT rule, e, row_number() OVER (PARTITION BY rule ORDER BY e) AS k, count(*) OVER (PARTITION BY rule) AS failures FROM b)
SELECT rule, failures, string_agg(e, '|' ORDER BY e) FILTER (WHERE k <= 20) AS examples FROM r GROUP BY rule, failures""")
def _(s, d):
    rules = {"price": F.col("o_totalprice") > 5000, "status": F.col("o_orderstatus").isin("F", "O")}
    return validate.check_rules(table(s, d, "orders"), rules, F.col("o_orderkey")).select("rule", "failures", "examples")


@query("count_unstored", "SELECT 'p_type' AS \"column\", count(*) FILTER (WHERE length(p_type) > 0) AS n FROM part UNION ALL SELECT 'p_brand', count(*) FILTER (WHERE length(p_brand) > 0) FROM part")
def _(s, d):
    return validate.count_unstored(table(s, d, "part"), ["p_type", "p_brand"])


@query("orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'")
    return resolve.orphans(table(s, d, "lineitem"), o, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("missing_parent_summary", """SELECT o_custkey AS symbol, count(DISTINCT o_orderkey) AS occurrences, CAST(sum(coalesce(f, 0)) AS BIGINT) AS facts, min(o_orderkey) AS first_row
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) GROUP BY 1""")
def _(s, d):
    occ = table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("occurrence_id"), F.col("o_orderkey").alias("row_no"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("occurrence_id"))
    return resolve.missing_parent_summary(occ, lines, table(s, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("symbol")))


@query("resolve_references", B.sql("""SELECT t.taxon_id, t.accepted_id, a.taxon_id AS resolved_accepted_id, t.parent_id, p.taxon_id AS resolved_parent_id FROM taxa t
LEFT JOIN taxa a ON a.is_current AND a.taxon_id = t.accepted_id LEFT JOIN taxa p ON p.is_current AND p.taxon_id = t.parent_id""", "taxa"))
def _(s, d):
    return resolve.resolve_references(B.taxa(s, d), ["accepted_id", "parent_id"], "taxon_id").select("taxon_id", "accepted_id", "resolved_accepted_id", "parent_id", "resolved_parent_id")


# Two thirds of the references are null, and one part is named by a sixth of all lines
@query("resolve_skewed", """SELECT l_orderkey, l_linenumber, r AS ref, p_partkey AS resolved_ref FROM (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN 1 WHEN (l_orderkey + l_linenumber) % 6 = 1 THEN l_partkey END AS r FROM lineitem) LEFT JOIN part ON p_partkey = r AND p_partkey % 9 <> 0""")
def _(s, d):
    at = F.col("l_orderkey") + F.col("l_linenumber")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(at % 6 == 0, 1).when(at % 6 == 1, F.col("l_partkey")).alias("ref"))
    return lookup.referenced(lines, {"ref": "resolved_ref"}, table(s, d, "part").where("p_partkey % 9 <> 0").select("p_partkey"))


@query("reference_counts", B.sql("""SELECT 'accepted_id' AS reference, count(a.taxon_id) AS resolved, count(t.accepted_id) - count(a.taxon_id) AS unresolved FROM taxa t LEFT JOIN taxa a ON a.is_current AND a.taxon_id = t.accepted_id
UNION ALL SELECT 'parent_id', count(a.taxon_id), count(t.parent_id) - count(a.taxon_id) FROM taxa t LEFT JOIN taxa a ON a.is_current AND a.taxon_id = t.parent_id""", "taxa"))
def _(s, d):
    refs = ["accepted_id", "parent_id"]
    return resolve.reference_counts(resolve.resolve_references(B.taxa(s, d), refs, "taxon_id"), refs)


@query("refresh_links", B.sql("""SELECT m.id, t.taxon_id AS resolved_id, coalesce(t.taxon_id, -1) <> coalesce(m.was, -1) AS changed
FROM (SELECT o_orderkey AS k, o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS was FROM orders) m LEFT JOIN taxa t ON t.taxon_id = m.id AND t.is_current""", "taxa"))
def _(s, d):
    m = table(s, d, "orders").selectExpr("o_custkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS resolved_id")
    return resolve.refresh_links(m, B.taxa(s, d).where("is_current"), ["id"])


CHAIN = """WITH walk AS (SELECT taxon_id AS id, taxon_id AS node, [taxon_id] AS path, false AS again FROM taxa
UNION ALL SELECT w.id, e.new_id, list_append(w.path, e.new_id), list_contains(w.path, e.new_id) FROM walk w JOIN edges e ON e.old_id = w.node WHERE NOT w.again AND len(w.path) <= 65),
ends AS (SELECT id, arg_max(node, len(path)) AS node, arg_max(again, len(path)) AS again, max(len(path)) AS n FROM walk GROUP BY id),
chain AS (SELECT e.id, CASE WHEN again OR n <= 65 THEN e.node END AS resolved, CASE WHEN again THEN 'Cycle' WHEN n > 65 THEN 'DepthLimit' WHEN t.taxon_id IS NOT NULL THEN 'Resolved' ELSE 'NotFound' END AS status
FROM ends e LEFT JOIN taxa t ON t.taxon_id = e.node AND t.is_current)"""


@query("resolve_chain", B.sql(CHAIN + " SELECT id, resolved, status, id <> resolved AS was_redirected FROM chain WHERE status <> 'DepthLimit' UNION ALL SELECT id, NULL, status, true FROM chain WHERE status = 'DepthLimit'", "taxa", "edges", recursive=True))
def _(s, d):
    return _chain(s, d, B.edges(s, d))


def _chain(s, d, edges):
    t = B.taxa(s, d)
    out = resolve.resolve_chain(t.select(F.col("taxon_id").alias("id")), edges, t.where("is_current").select("taxon_id"))
    far = F.col("status") == "DepthLimit"
    return out.select("id", F.when(~far, F.col("resolved")).alias("resolved"), "status", "was_redirected")


@query("validate_chain_graph", B.sql(CHAIN.replace("FROM taxa\nUNION", "FROM taxa WHERE taxon_id IN (SELECT old_id FROM edges)\nUNION") + " SELECT count(*) FILTER (WHERE status = 'Cycle') AS cycles, count(*) FILTER (WHERE status = 'DepthLimit') AS too_long FROM chain", "taxa", "edges", recursive=True))
def _(s, d):
    return resolve.validate_chain_graph(B.edges(s, d))


@query("resolve_item_links", B.sql(CHAIN + """ SELECT t.taxon_id AS qid, CASE WHEN ok THEN c.resolved END AS resolved, CASE WHEN ok AND c.status = 'Resolved' THEN c.resolved END AS taxon,
CASE WHEN ok AND c.status = 'Resolved' THEN CASE r.status WHEN 'Accepted' THEN r.taxon_id WHEN 'Synonym' THEN a.taxon_id END END AS accepted, CASE WHEN ok THEN c.status ELSE 'NotFound' END AS status
FROM (SELECT taxon_id, taxon_id % 13 <> 0 AS ok FROM taxa) t JOIN chain c ON c.id = t.taxon_id LEFT JOIN taxa r ON r.taxon_id = c.resolved AND r.is_current LEFT JOIN taxa a ON a.taxon_id = r.accepted_id AND a.is_current""", "taxa", "edges", recursive=True))
def _(s, d):
    return _item_links(s, d, B.taxa(s, d), B.edges(s, d))


def _item_links(s, d, chosen, edges):
    links = chosen.selectExpr("taxon_id AS qid", "taxon_id AS taxon_id_raw")
    out = resolve.resolve_item_links(links, edges, B.taxa(s, d), F.col("taxon_id_raw") % 13 != 0)
    return out.select("qid", F.when(F.col("status") != "DepthLimit", F.col("resolved")).alias("resolved"), "taxon", "accepted", "status")


@query("resolution_report", B.sql("""SELECT CASE WHEN a.taxon_id IS NULL THEN 'NotFound' ELSE 'Resolved' END AS status, count(*) AS n, count(a.taxon_id) AS resolved, count(CASE WHEN a.status = 'Accepted' THEN 1 END) AS accepted, CAST(0 AS BIGINT) AS redirected
FROM taxa t LEFT JOIN taxa a ON a.taxon_id = t.taxon_id AND a.is_current GROUP BY 1""", "taxa"))
def _(s, d):
    t = B.taxa(s, d)
    links = t.selectExpr("taxon_id AS qid", "CASE WHEN is_current THEN taxon_id END AS taxon", "CASE WHEN is_current AND status = 'Accepted' THEN taxon_id END AS accepted", "CASE WHEN is_current THEN 'Resolved' ELSE 'NotFound' END AS status", "false AS was_redirected")
    return profile.resolution_report(links)


@query("accepted_of", B.sql("SELECT t.taxon_id, CASE t.status WHEN 'Accepted' THEN t.taxon_id WHEN 'Synonym' THEN a.taxon_id END AS accepted FROM taxa t LEFT JOIN taxa a ON a.taxon_id = t.accepted_id AND a.is_current WHERE t.is_current", "taxa"))
def _(s, d):
    return resolve.accepted_of(B.taxa(s, d))


@query("link_by_precedence", """WITH cur AS (SELECT p_partkey AS taxon_id, p_name AS name, p_size % 2 = 0 AS even FROM part WHERE p_partkey % 11 <> 0),
via AS (SELECT s.s_suppkey AS symbol, list(DISTINCT c.taxon_id ORDER BY c.taxon_id) AS cs FROM supplier s JOIN cur c ON c.taxon_id % 400 = s.s_suppkey AND c.taxon_id % 3 = 0 WHERE s.s_suppkey % 2 = 0 GROUP BY 1),
nam AS (SELECT s.s_suppkey AS symbol, list(DISTINCT c.taxon_id ORDER BY c.taxon_id) FILTER (WHERE c.taxon_id IS NOT NULL) AS cs FROM supplier s JOIN part p ON p.p_partkey = s.s_suppkey
 LEFT JOIN cur c ON c.name = p.p_name AND c.even = (p.p_size % 2 = 0) WHERE s.s_suppkey NOT IN (SELECT symbol FROM via) GROUP BY 1)
SELECT symbol, CASE WHEN len(cs) = 1 THEN cs[1] END AS taxon, 'external' AS method, CASE WHEN len(cs) = 1 THEN 'Linked' ELSE 'Conflict' END AS status, CAST(len(cs) AS BIGINT) AS n FROM via
UNION ALL SELECT symbol, CASE WHEN len(cs) = 1 THEN cs[1] END, 'name', CASE WHEN cs IS NULL THEN 'NotFound' WHEN len(cs) = 1 THEN 'Linked' ELSE 'Ambiguous' END, CAST(coalesce(len(cs), 0) AS BIGINT) FROM nam""")
def _(s, d):
    p = table(s, d, "part")
    named = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol")).join(p, F.col("symbol") == F.col("p_partkey"))
    symbols = sup.select("symbol", F.concat(named, F.lit(" Mill.")).alias("name"), F.lit("species").alias("rank"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("even"))
    taxa = p.select(F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("name"), F.lit("species").alias("rank"), (F.col("p_partkey") % 11 != 0).alias("is_current"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("even"))
    ext = p.where("p_partkey % 400 % 2 = 0 AND p_partkey % 3 = 0").selectExpr("p_partkey AS qid", "p_partkey % 400 AS value")
    links = p.selectExpr("p_partkey AS qid", "p_partkey AS taxon")
    parts = [resolve.link_by_precedence(symbols.where(f"even = {e}").drop("even"), ext, links, taxa.withColumn("rank", F.when(F.col("even") == e, "species").otherwise("other")).drop("even")) for e in (0, 1)]
    return parts[0].unionByName(parts[1]).select("symbol", "taxon", "method", "status", F.size("candidates").cast("long").alias("n"))


# Links of every seventh item and every fifth item itself are retired; a symbol's items are shown
@query("link_current", """WITH cur AS (SELECT p_partkey AS taxon_id FROM part WHERE p_partkey % 11 <> 0),
via AS (SELECT s.s_suppkey AS symbol, list(DISTINCT p.p_partkey - p.p_partkey % 2 ORDER BY p.p_partkey - p.p_partkey % 2) AS cs, string_agg(DISTINCT CAST(p.p_partkey AS VARCHAR), ',' ORDER BY CAST(p.p_partkey AS VARCHAR)) AS qids
 FROM supplier s JOIN part p ON p.p_partkey % 100 = s.s_suppkey AND p.p_partkey % 5 <> 0 AND p.p_partkey % 7 <> 0 JOIN cur c ON c.taxon_id = p.p_partkey - p.p_partkey % 2 GROUP BY 1)
SELECT s.s_suppkey AS symbol, CASE WHEN len(cs) = 1 THEN cs[1] END AS taxon, CASE WHEN cs IS NULL THEN 'name' ELSE 'external' END AS method, CASE WHEN cs IS NULL THEN 'NotFound' WHEN len(cs) = 1 THEN 'Linked' ELSE 'Conflict' END AS status, coalesce(qids, '') AS qids
FROM supplier s LEFT JOIN via ON via.symbol = s.s_suppkey""")
def _(s, d):
    p = table(s, d, "part")
    symbols = table(s, d, "supplier").selectExpr("s_suppkey AS symbol", "CAST(NULL AS STRING) AS name", "'species' AS rank")
    taxa = p.selectExpr("p_partkey AS taxon_id", "p_name AS name", "'species' AS rank", "p_partkey % 11 <> 0 AS is_current")
    ext = p.selectExpr("p_partkey AS qid", "p_partkey % 100 AS value")
    items = p.selectExpr("p_partkey AS qid", "p_partkey % 5 <> 0 AS is_current")
    links = p.selectExpr("p_partkey AS qid", "p_partkey - p_partkey % 2 AS taxon", "p_partkey % 7 <> 0 AS is_current")
    out = resolve.link_by_precedence(symbols, ext, links, taxa, items)
    return out.select("symbol", "taxon", "method", "status", F.array_join("qids", ",").alias("qids"))


# What stands behind a conflict, an ambiguous name or a link by external id
@query("link_evidence", """WITH l AS (SELECT p_brand AS symbol, list(DISTINCT p_partkey ORDER BY p_partkey) AS cs FROM part WHERE p_size = 7 GROUP BY 1)
SELECT symbol, CASE WHEN len(cs) = 1 THEN 'Linked' ELSE 'Conflict' END AS status, CASE WHEN len(cs) > 1 THEN (SELECT string_agg(taxon_id || ':' || name || ':' || status, '|' ORDER BY taxon_id) FROM taxa WHERE list_contains(cs, taxon_id)) END AS told FROM l""".replace("WITH l AS", "WITH taxa AS (SELECT " + B.TAXA + " FROM part), l AS"))
def _(s, d):
    p = table(s, d, "part").where("p_size = 7").groupBy(F.col("p_brand").alias("symbol")).agg(F.array_sort(F.collect_set("p_partkey")).alias("candidates"))
    links = p.select("symbol", F.when(F.size("candidates") == 1, "Linked").otherwise("Conflict").alias("status"), "candidates", F.array(F.lit("Q1")).alias("qids"))
    out = resolve.link_evidence(links, B.taxa(s, d).withColumn("is_current", F.lit(True)))
    return out.select("symbol", "status", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c.taxon_id.cast("string"), c["name"], c.status)), "|").alias("told"))


@query("lookup_ext_id", B.sql(CHAIN + """, q AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN ' URN:LSID:ipni.org:names:' || c_custkey || '-1 ' ELSE c_custkey || '-1' END AS query FROM customer),
m AS (SELECT p_partkey || '-1' AS nid, p_partkey AS t FROM part WHERE p_partkey % 3 <> 0 UNION SELECT p_partkey || '-1', p_partkey + 7 FROM part WHERE p_partkey % 5 = 0),
e AS (SELECT q.query, count(*) FILTER (WHERE c.status IN ('Cycle', 'DepthLimit')) AS broken, count(DISTINCT c.resolved) FILTER (WHERE c.status = 'Resolved') AS n, min(c.resolved) FILTER (WHERE c.status = 'Resolved') AS taxon
 FROM (SELECT DISTINCT query FROM q WHERE trim(query) <> '') q JOIN m ON m.nid = replace(trim(q.query), 'URN:LSID:ipni.org:names:', '') LEFT JOIN chain c ON c.id = m.t GROUP BY 1),
s AS (SELECT q.query, CASE WHEN trim(q.query) = '' THEN 'Invalid' WHEN broken > 0 OR n > 1 THEN 'Conflict' WHEN coalesce(n, 0) = 0 THEN 'NotFound' ELSE 'Found' END AS status, taxon FROM (SELECT DISTINCT query FROM q) q LEFT JOIN e ON e.query = q.query)
SELECT query, status, CASE WHEN status = 'Found' THEN taxon END AS taxon FROM s""", "taxa", "edges", recursive=True))
def _(s, d):
    return _lookup(s, d, B.edges(s, d))


def _lookup(s, d, edges):
    q = table(s, d, "customer").selectExpr("CASE WHEN c_custkey % 50 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN ' URN:LSID:ipni.org:names:' || c_custkey || '-1 ' ELSE c_custkey || '-1' END AS query")
    p = table(s, d, "part")
    m = p.where("p_partkey % 3 <> 0").selectExpr("p_partkey || '-1' AS normalized_id", "p_partkey AS taxon_id").union(p.where("p_partkey % 5 = 0").selectExpr("p_partkey || '-1'", "p_partkey + 7"))
    return resolve.lookup_ext_id(q, m, edges, B.taxa(s, d))


@query("taxon_detail", B.sql(CHAIN + """ SELECT c.id, c.resolved, t.name, a.taxon_id AS accepted, a.name AS accepted_name, p.name AS parent_name FROM chain c LEFT JOIN taxa t ON t.taxon_id = c.resolved AND t.is_current
LEFT JOIN taxa a ON a.taxon_id = t.accepted_id AND a.is_current LEFT JOIN taxa p ON p.taxon_id = t.parent_id AND p.is_current""", "taxa", "edges", recursive=True))
def _(s, d):
    return _detail(s, d, B.taxa(s, d), B.edges(s, d))


def _detail(s, d, chosen, edges):
    t = B.taxa(s, d).withColumnRenamed("status", "taxonomic_status")
    out = resolve.taxon_detail(chosen.select(F.col("taxon_id").alias("id")), edges, t, ["accepted_id", "parent_id"])
    return out.select("id", F.when(F.col("status") != "DepthLimit", F.col("resolved")).alias("resolved"), "name", F.col("accepted_id_record.id").alias("accepted"), F.col("accepted_id_record.name").alias("accepted_name"), F.col("parent_id_record.name").alias("parent_name"))


@query("coverage", B.sql("""SELECT count(*) AS accepted_species, count(h) AS linked, round_even(count(h) * 100.0 / count(*), 2) AS percent FROM (SELECT taxon_id, (SELECT 1 FROM item_links l WHERE l.accepted = t.taxon_id AND l.qid % 4 = 0 LIMIT 1) AS h FROM taxa t WHERE is_current AND status = 'Accepted' AND rank = 'species')""", "taxa", "item_links"))
def _(s, d):
    return resolve.coverage(B.taxa(s, d), B.item_links(s, d).where("qid % 4 = 0"))


@query("trace_path", B.sql("""WITH sym AS (SELECT c_custkey AS symbol, p_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS accepted FROM customer JOIN part ON p_partkey = c_custkey + 1),
b AS (SELECT symbol, coalesce(accepted, (SELECT min(t.taxon_id) FROM taxa t WHERE t.is_current AND t.status = 'Accepted' AND t.name = sym.name)) AS taxon FROM sym),
m AS (SELECT b.symbol, b.taxon, l.qid, l.taxon = b.taxon AS own FROM b JOIN item_links l ON l.qid % 5 <> 0 AND (l.taxon = b.taxon OR l.accepted = b.taxon)),
r AS (SELECT m.*, p_name AS title, row_number() OVER (PARTITION BY symbol ORDER BY own DESC, qid, p_name) AS k FROM m JOIN part ON p_partkey = m.qid AND p_size > 10)
SELECT symbol, taxon, qid, title, own FROM r WHERE k <= 3""", "taxa", "item_links"))
def _(s, d):
    symbols = table(s, d, "customer").join(table(s, d, "part"), F.col("p_partkey") == F.col("c_custkey") + 1).selectExpr("c_custkey AS symbol", "p_name AS name")
    links = table(s, d, "customer").selectExpr("c_custkey AS symbol", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS accepted")
    arts = table(s, d, "part").selectExpr("p_partkey AS qid", "p_name AS title", "p_size > 10 AS is_current")
    return resolve.trace_path(symbols, links, B.taxa(s, d), B.item_links(s, d).withColumn("is_current", F.col("qid") % 5 != 0), arts)


@query("best_names", B.sql("""SELECT DISTINCT ON (target) target, name AS common_name FROM (SELECT coalesce(l.accepted, l.taxon) AS target, n.* FROM names n JOIN item_links l ON l.qid = n.qid WHERE language = 'en' OR language LIKE 'en-%') ORDER BY target, language <> 'en', length(name), name""", "names", "item_links"))
def _(s, d):
    links = B.item_links(s, d)
    return resolve.best_name(links.select(F.coalesce("accepted", "taxon").alias("target")).distinct(), B.names(s, d), links)


@query("present_and_native", """SELECT count(*) AS present, count(n.k) AS present_and_native FROM (SELECT DISTINCT l_partkey AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND s_nationkey = 5) p
LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey = 7) n ON n.k = p.k""")
def _(s, d):
    dist = table(s, d, "lineitem").selectExpr("l_partkey AS symbol", "CASE l_returnflag WHEN 'R' THEN 'Present' WHEN 'A' THEN 'Native' END AS kind", "l_suppkey AS place_id")
    places = table(s, d, "supplier").selectExpr("s_suppkey AS place_id", "'US' AS country_code", "CAST(s_nationkey AS STRING) AS admin_code")
    return resolve.present_and_native(dist, places, "US", "5", 7)


@query("profile_snapshot", """SELECT 'distinct' AS metric, 'p_name' AS field, NULL AS value, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'distinct', 'p_brand', NULL, count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'group', 'p_type', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'group', 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size""")
def _(s, d):
    return profile.profile_snapshot(table(s, d, "part"), ["p_name", "p_brand"], ["p_type", "p_size"])


@query("duplicate_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(s, d):
    return profile.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])[0].select("l_orderkey", "l_linenumber", "l_partkey")


@query("duplicate_counts", "SELECT count(*) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(s, d):
    return profile.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])[1]


@query("snapshot_stats", B.sql("SELECT count(*) AS total, count(*) FILTER (WHERE is_current) AS current, count(DISTINCT family) FILTER (WHERE is_current) AS families, count(DISTINCT genus) FILTER (WHERE is_current) AS genera FROM taxa", "taxa"))
def _(s, d):
    return profile.snapshot_stats(B.taxa(s, d))


@query("mapping_stats", """SELECT count(*) AS total, count(DISTINCT l_suppkey) AS ext_ids, count(DISTINCT l_partkey) FILTER (WHERE p_partkey IS NOT NULL) AS taxa_found, count(DISTINCT l_partkey) FILTER (WHERE p_partkey IS NULL) AS taxa_absent, count(*) FILTER (WHERE l_suppkey = l_partkey) AS self_references
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey""")
def _(s, d):
    return profile.mapping_stats(table(s, d, "lineitem").selectExpr("l_suppkey AS ext_id", "l_partkey AS taxon_id"), table(s, d, "part").where("p_size > 5").selectExpr("p_partkey AS taxon_id"))


@query("multi_value_keys", """WITH d AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS k, CAST(l_suppkey AS VARCHAR) AS v FROM lineitem), m AS (SELECT k, count(*) AS n FROM d GROUP BY k HAVING count(*) > 1 ORDER BY length(k), k LIMIT 20)
SELECT m.k AS l_partkey, m.n, string_agg(v, ',' ORDER BY length(v), v) AS "values" FROM m JOIN d ON d.k = m.k GROUP BY m.k, m.n""")
def _(s, d):
    return profile.multi_value_keys(table(s, d, "lineitem"), "l_partkey", "l_suppkey")


@query("multi_value_count", "SELECT count(*) AS keys FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def _(s, d):
    return profile.multi_value_count(table(s, d, "lineitem"), "l_partkey", "l_suppkey")


@query("snapshot_relations", B.sql("""SELECT 'accepted_id' AS reference, count(a.taxon_id) AS resolved, count(t.accepted_id) - count(a.taxon_id) AS unresolved FROM taxa t LEFT JOIN taxa a ON a.is_current AND a.taxon_id = t.accepted_id WHERE t.is_current
UNION ALL SELECT 'parent_id', count(a.taxon_id), count(t.parent_id) - count(a.taxon_id) FROM taxa t LEFT JOIN taxa a ON a.is_current AND a.taxon_id = t.parent_id WHERE t.is_current""", "taxa"))
def _(s, d):
    return profile.snapshot_relations(B.taxa(s, d), ["accepted_id", "parent_id"])


@query("language_counts", B.sql("SELECT language, count(*) AS n FROM names JOIN taxa ON taxon_id = qid WHERE is_current GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "names", "taxa"))
def _(s, d):
    return profile.language_counts(B.taxa(s, d).selectExpr("taxon_id AS qid", "is_current"), B.names(s, d))


@query("item_summary", B.sql("""SELECT count(*) AS current, count(CASE WHEN taxon_id % 2 = 0 THEN 1 END) AS fetched, count(name) AS titled, count(CASE WHEN taxon_id % 5 = 0 THEN 1 END) AS pictured, count(CASE WHEN taxon_id % 3 < 2 THEN 1 END) AS english FROM taxa WHERE is_current""", "taxa"))
def _(s, d):
    items = B.taxa(s, d).selectExpr("taxon_id AS qid", "is_current", "CASE WHEN taxon_id % 2 = 0 THEN 1 END AS last_rev_id", "name AS title", "CASE WHEN taxon_id % 5 = 0 THEN 1 END AS image")
    return profile.item_summary(items, B.names(s, d))


@query("top_values", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s, d):
    return profile.top_values(table(s, d, "customer"), "c_mktsegment")


@query("fact_counts", """SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('error', 'signup')) AS any_of, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT props) > 2)) AS many""")
def _(s, d):
    f = table(s, d, "events").selectExpr("user_id AS symbol", "event_type AS key", "props AS code")
    return profile.taxa_with_any(f, ["error", "signup"]).select(F.col("taxa").alias("any_of")).crossJoin(profile.taxa_with_many_values(f, "error").select(F.col("taxa").alias("many")))


@query("length_profile", """SELECT count(*) AS n, min(length(text)) AS min_chars, quantile_disc(length(text), 0.1) AS p10, quantile_disc(length(text), 0.5) AS median, quantile_disc(length(text), 0.9) AS p90, max(length(text)) AS max_chars,
count(*) FILTER (WHERE length(text) < 200) AS short, count(*) FILTER (WHERE regexp_matches(text, '^[^.]+ is a (species|genus) of') AND NOT regexp_matches(text, '[.!?]\\s+\\S')) AS single,
count(*) FILTER (WHERE length(text) < 200 OR regexp_matches(text, '^[^.]+ is a (species|genus) of') AND NOT regexp_matches(text, '[.!?]\\s+\\S')) AS stubs FROM documents""")
def _(s, d):
    return profile.length_profile(table(s, d, "documents").select(F.col("text").alias("lead"), F.lit("Ok").alias("status")))


@query("rank_coverage", """SELECT CASE p_size % 4 WHEN 0 THEN 'genus' WHEN 1 THEN 'species' WHEN 2 THEN 'infraspecific' ELSE 'other' END AS bucket, count(*) AS articles, count(*) FILTER (WHERE s = 'Ok') AS ok FROM (SELECT DISTINCT p_name, CASE WHEN p_partkey % 2 = 0 THEN 'Ok' ELSE 'Missing' END AS s, p_size % 4 AS p_size FROM part) GROUP BY 1""")
def _(s, d):
    t = B.taxa(s, d)
    return profile.rank_coverage(t.select(F.col("name").alias("title"), F.when(F.col("taxon_id") % 2 == 0, "Ok").otherwise("Missing").alias("status"), "rank"))


@query("link_report", """WITH r AS (SELECT o_orderstatus AS status, o_orderpriority AS method, CAST(o_orderkey AS VARCHAR) AS e, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY CAST(o_orderkey AS VARCHAR)) AS k FROM orders)
SELECT status, method, count(*) AS n, string_agg(e, '|' ORDER BY e) FILTER (WHERE k <= 20) AS examples FROM r GROUP BY 1, 2""")
def _(s, d):
    return profile.link_report(table(s, d, "orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS method", "o_orderkey AS symbol"))


LABELS = [("click", None, "Click (any)", "verified"), ("view", None, "View", "inferred"), ("error", None, "Error", "verified"), ("error", "error", None, "unresolved"), ("click", "click", "Own click", "inferred")]
LABEL_SQL = """types(type_uri, key, value_kind) AS (VALUES ('click', 'k_click', 'coded'), ('view', 'k_view', 'coded'), ('error', 'k_error', 'coded'), ('purchase', 'k_buy', 'numeric')),
labels(code, type_uri, label, confidence) AS (VALUES ('click', NULL, 'Click (any)', 'verified'), ('view', NULL, 'View', 'inferred'), ('error', NULL, 'Error', 'verified'), ('error', 'error', NULL, 'unresolved'), ('click', 'click', 'Own click', 'inferred')),
lf AS (SELECT e.event_id AS row_no, e.user_id AS symbol, e.event_type AS code, t.key, t.value_kind, CASE WHEN o.code IS NOT NULL THEN o.label ELSE g.label END AS label, CASE WHEN o.code IS NOT NULL THEN o.confidence ELSE g.confidence END AS confidence,
CASE WHEN t.value_kind = 'numeric' THEN e.props WHEN o.code IS NOT NULL AND o.label IS NULL THEN e.event_type || ' (' || o.confidence || ')' WHEN o.code IS NOT NULL THEN o.label WHEN g.label IS NOT NULL THEN g.label ELSE e.event_type || ' (unmapped)' END AS display
FROM events e LEFT JOIN types t ON t.type_uri = e.event_type LEFT JOIN labels o ON o.code = e.event_type AND o.type_uri = e.event_type LEFT JOIN labels g ON g.code = e.event_type AND g.type_uri IS NULL)"""


def _labelled(s, d):
    f = table(s, d, "events").selectExpr("event_id AS row_no", "user_id AS symbol", "event_type AS type_uri", "event_type AS code", "props AS value_raw", "value AS numeric")
    types = s.createDataFrame([("click", "k_click", "coded"), ("view", "k_view", "coded"), ("error", "k_error", "coded"), ("purchase", "k_buy", "numeric")], "type_uri string, key string, value_kind string")
    return facts.label_facts(f, types, s.createDataFrame(LABELS, "code string, type_uri string, label string, confidence string"))


@query("label_facts", f"WITH {LABEL_SQL} SELECT row_no, symbol, key, label, confidence, display FROM lf")
def _(s, d):
    return _labelled(s, d).select("row_no", "symbol", "key", "label", "confidence", "display")


@query("label_coverage", f"WITH {LABEL_SQL} SELECT key, code, CASE WHEN confidence IS NULL THEN 'unmapped' ELSE 'unresolved' END AS gap, count(*) AS n FROM lf WHERE label IS NULL AND value_kind <> 'numeric' GROUP BY 1, 2, 3")
def _(s, d):
    return profile.label_coverage(_labelled(s, d))


# Modes of comparison over each user's events: a label with two values, the largest number, a label that is missing, a
# flag that only some labels belong to, and a set.
FIELDS = [("Action", "k_click", "Label", None), ("Top", "k_buy", "Max", None), ("Oops", "k_error", "Label", None), ("Low", "k_buy", "Min", None), ("View", "k_seen", "Flag", None), ("Kinds", "k_seen", "Set", None)]


def _facts_seen(s, d):
    """The labelled facts, and once more the clicks and views under one key, as flags and members of a set."""
    own = _labelled(s, d).select("row_no", "symbol", "code", "key", "label", "confidence", "label_type", F.when(F.col("key") == "k_buy", F.col("numeric").cast("decimal(38,15)")).alias("numeric"), F.lit(None).cast("string").alias("statistic"))
    label = F.when(F.col("code") == "view", F.concat(F.lit("View: "), F.when(F.col("symbol") % 5 == 0, "No").otherwise("Yes"))).otherwise("Plain click")
    seen = own.where("code in ('click', 'view')").withColumns({"key": F.lit("k_seen"), "label": label, "confidence": F.when(F.col("code") == "view", "inferred").otherwise("verified"), "label_type": F.lit(None).cast("string")})
    return own.unionByName(seen)


def _compared(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("symbol")).distinct()
    values = [("aCTION", "CASE WHEN symbol % 2 = 0 THEN 'own CLICK' ELSE 'other' END"), ("aCTION", "CASE WHEN symbol % 4 = 0 THEN 'third' ELSE 'own click' END"), ("Top", "'99'"), ("Low", "'1'"), ("Oops", "'x'"), ("view", "'YES'"), ("Kinds", "'plain click'"), ("Kinds", "CASE WHEN symbol % 2 = 0 THEN 'View: yes' ELSE 'plain click' END")]
    theirs = None
    for field, value in values:
        rows = e.selectExpr("symbol", f"'{field}' AS field", f"{value} AS value")
        theirs = rows if theirs is None else theirs.unionByName(rows)
    mapping = s.createDataFrame(FIELDS, "field string, key string, mode string, statistic string")
    ours = _facts_seen(s, d)
    return facts.compare_facts(ours, theirs, mapping), ours


COMPARED = f"""WITH {LABEL_SQL}, u AS (SELECT DISTINCT user_id AS symbol FROM events),
has AS (SELECT user_id AS symbol, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS views,
 max(CAST(value AS DECIMAL(20, 4))) FILTER (WHERE event_type = 'purchase') AS hi, min(CAST(value AS DECIMAL(20, 4))) FILTER (WHERE event_type = 'purchase') AS lo FROM events GROUP BY 1),
said AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'own CLICK' ELSE 'other' END AS value FROM u UNION SELECT symbol, CASE WHEN symbol % 4 = 0 THEN 'third' ELSE 'own click' END FROM u),
kinds AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN ['plain click', 'view: yes'] ELSE ['plain click'] END AS they,
 CASE WHEN clicks > 0 AND views > 0 THEN ['plain click', CASE WHEN symbol % 5 = 0 THEN 'view: no' ELSE 'view: yes' END] WHEN clicks > 0 THEN ['plain click'] WHEN views > 0 THEN [CASE WHEN symbol % 5 = 0 THEN 'view: no' ELSE 'view: yes' END] ELSE [] END AS we FROM has),
cmp AS (SELECT s.symbol, 'k_click' AS key, 'Action' AS field, 'Label' AS mode, value, CASE WHEN clicks = 0 THEN 'Missing' WHEN lower(value) = 'own click' THEN 'Agree' ELSE 'Disagree' END AS outcome FROM said s JOIN has ON has.symbol = s.symbol
UNION ALL SELECT symbol, 'k_buy', 'Top', 'Max', '99', CASE WHEN hi IS NULL THEN 'Missing' WHEN abs(hi - 99) <= 0.000001 THEN 'Agree' ELSE 'Disagree' END FROM has
UNION ALL SELECT symbol, 'k_buy', 'Low', 'Min', '1', CASE WHEN lo IS NULL THEN 'Missing' WHEN abs(lo - 1) <= 0.000001 THEN 'Agree' ELSE 'Disagree' END FROM has
UNION ALL SELECT symbol, 'k_error', 'Oops', 'Label', 'x', CASE WHEN errors = 0 THEN 'Missing' ELSE 'Unresolved' END FROM has
UNION ALL SELECT symbol, 'k_seen', 'View', 'Flag', 'YES', CASE WHEN views = 0 THEN 'Missing' WHEN views = 1 AND symbol % 5 <> 0 THEN 'Agree' ELSE 'Disagree' END FROM has
UNION ALL SELECT has.symbol, 'k_seen', 'Kinds', 'Set', NULL, CASE WHEN clicks + views = 0 THEN 'Missing' WHEN we = they THEN 'Agree' ELSE 'Disagree' END FROM has JOIN kinds ON kinds.symbol = has.symbol)"""


@query("compare_facts", f"{COMPARED} SELECT symbol, key, field, mode, value, outcome FROM cmp")
def _(s, d):
    return _compared(s, d)[0].drop("they")


TALLIED = f"""{COMPARED}, seen AS (SELECT user_id AS symbol, event_type AS code, CASE event_type WHEN 'view' THEN 'inferred' ELSE 'verified' END AS confidence, CASE WHEN event_type = 'click' THEN 'plain click' WHEN user_id % 5 = 0 THEN 'view: no' ELSE 'view: yes' END AS label FROM events WHERE event_type IN ('click', 'view')),
hits AS (SELECT lf.code, lf.confidence, cmp.symbol, outcome = 'Agree' AS ok FROM cmp JOIN lf ON lf.symbol = cmp.symbol AND lf.key = cmp.key WHERE mode = 'Label' AND outcome IN ('Agree', 'Disagree')
UNION ALL SELECT code, confidence, cmp.symbol, outcome = 'Agree' FROM cmp JOIN seen ON seen.symbol = cmp.symbol WHERE mode = 'Flag' AND outcome IN ('Agree', 'Disagree') AND code = 'view'
UNION ALL SELECT code, confidence, cmp.symbol, list_contains(they, label) FROM cmp JOIN seen ON seen.symbol = cmp.symbol JOIN kinds ON kinds.symbol = cmp.symbol WHERE mode = 'Set' AND outcome IN ('Agree', 'Disagree')),
tally AS (SELECT code, confidence, count(*) FILTER (WHERE ok) AS agree, count(*) FILTER (WHERE NOT ok) AS disagree, count(DISTINCT CASE WHEN ok THEN symbol END) AS agreeing_taxa FROM hits GROUP BY 1, 2)"""


@query("tally_codes", f"{TALLIED} SELECT code, confidence, CAST(sum(agree) AS BIGINT) AS agree, CAST(sum(disagree) AS BIGINT) AS disagree, CAST(max(agreeing_taxa) AS BIGINT) AS agreeing_taxa FROM tally GROUP BY 1, 2")
def _(s, d):
    return facts.tally_codes(*_compared(s, d)).select("code", "confidence", "agree", "disagree", "agreeing_taxa")


# a code is a part, a fact one of its lines, a trait the line number; every thirteenth order disagrees, trait k7 is not a
# tolerance
@query("promoted_codes", """SELECT l_partkey AS code, count(DISTINCT l_orderkey) AS agreeing_taxa FROM lineitem GROUP BY 1
HAVING count(*) FILTER (WHERE l_orderkey % 13 = 0) = 0 AND count(*) FILTER (WHERE l_linenumber = 7) = 0 AND count(DISTINCT l_orderkey) >= 3""")
def _(s, d):
    ours = table(s, d, "lineitem").selectExpr("l_orderkey AS symbol", "concat('k', l_linenumber) AS key", "l_partkey AS code", "CAST(NULL AS STRING) AS label_type", "'inferred' AS confidence", "CAST(l_partkey AS STRING) AS label")
    outcomes = ours.select("symbol", "key").distinct().selectExpr("symbol", "key", "IF(symbol % 13 = 0, 'Disagree', 'Agree') AS outcome")
    return facts.promoted(facts.tally_codes(outcomes, ours), 3, tuple(f"k{i}" for i in range(1, 7))).select("code", "agreeing_taxa")


# codes of every fifth supplier have no label row
@query("unmapped_observations", """WITH f AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2)
SELECT 'k' || l_linenumber AS key, 'c' || s AS code, v AS value, count(*) AS n FROM f WHERE s % 5 = 0 GROUP BY 1, 2, 3""")
def _(s, d):
    first = written(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("v")), "first")
    ours = first.selectExpr("l_orderkey AS symbol", "concat('k', l_linenumber) AS key", "concat('c', s) AS code", "IF(s % 5 <> 0, 'label', NULL) AS label", "IF(s % 5 <> 0, 'verified', NULL) AS confidence", "CAST(NULL AS DECIMAL(38, 15)) AS numeric", "CAST(NULL AS STRING) AS statistic")
    theirs = first.selectExpr("l_orderkey AS symbol", "concat('F', l_linenumber) AS field", "v AS value")
    mapping = s.createDataFrame([(f"F{i}", f"k{i}", "Label", None) for i in range(1, 8)], "field string, key string, mode string, statistic string")
    return facts.unmapped_observations(facts.compare_facts(ours, theirs, mapping), ours)


@query("verification_verdict", f"{TALLIED} SELECT count(*) FILTER (WHERE confidence = 'verified' AND disagree > 0) = 0 AS passed, count(*) FILTER (WHERE confidence = 'verified' AND disagree > 0) AS contradicted FROM tally")
def _(s, d):
    return facts.passed(facts.tally_codes(*_compared(s, d)))


@query("trait_tally", f"""{COMPARED} SELECT key, field, count(*) FILTER (WHERE outcome = 'Agree') AS agree, count(*) FILTER (WHERE outcome = 'Disagree') AS disagree, count(*) FILTER (WHERE outcome = 'Missing') AS missing,
count(*) FILTER (WHERE outcome = 'Unmapped') AS unmapped, count(*) FILTER (WHERE outcome = 'Unresolved') AS unresolved FROM cmp GROUP BY 1, 2""")
def _(s, d):
    return facts.trait_tally(_compared(s, d)[0])


# a user's distinct click is the observed shade; every tenth user has an error as well, so two facts and no observation
@query("shade_score", """WITH one AS (SELECT symbol FROM (SELECT DISTINCT user_id AS symbol, event_type FROM events WHERE event_type = 'click' OR event_type = 'error' AND user_id % 10 = 0) GROUP BY 1 HAVING count(*) = 1 AND max(event_type) = 'click')
SELECT 'shade' AS key, 'Shade' AS field, count(*) AS compared, count(*) FILTER (WHERE symbol % 3 = 0) AS direct_agreements, count(*) FILTER (WHERE symbol % 3 = 1) AS inverted_agreements FROM one HAVING count(*) > 0""")
def _(s, d):
    ours = table(s, d, "events").where("event_type = 'click' OR event_type = 'error' AND user_id % 10 = 0").selectExpr("user_id AS symbol", "'shade' AS key", "event_type AS code").distinct()
    theirs = ours.select("symbol").distinct().selectExpr("symbol", "'sHADE' AS field", "CASE symbol % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'HIGH' ELSE 'Medium' END AS value")
    mapping = s.createDataFrame([("Shade", "shade", "Shade", None)], "field string, key string, mode string, statistic string")
    tolerance = s.createDataFrame([("click", "Low (tolerance)")], "code string, label string")
    return facts.shade_score(facts.shade_observations(ours, theirs, mapping, tolerance))


@query("attribute_facts", """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS symbol, CAST(l_quantity AS DOUBLE) AS number FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 WHERE l_returnflag <> 'R'""")
def _(s, d):
    f = table(s, d, "lineitem").selectExpr("l_orderkey AS occurrence_id", "l_orderkey", "l_linenumber", "l_partkey", f"CASE WHEN l_returnflag = 'R' THEN '{next(iter(T.DISTRIBUTION_KINDS))}' ELSE 'q' END AS type_uri", "CAST(l_quantity AS STRING) AS value_raw", "CAST(NULL AS STRING) AS remark_sha")
    occ = table(s, d, "orders").selectExpr("o_orderkey AS occurrence_id", "o_custkey AS symbol")
    tx = table(s, d, "customer").selectExpr("c_custkey AS symbol", "c_custkey % 3 <> 0 AS is_current")
    texts = table(s, d, "customer").selectExpr("sha2(c_name, 256) AS sha256", "c_name AS text")
    return facts.attribute_facts(f, occ, tx, texts)[0].select("l_orderkey", "l_linenumber", "l_partkey", "symbol", F.col("value_numeric").cast("double").alias("number"))


@query("first_per_key", "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey")
def _(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dedup.first_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("dictionary_encode", "SELECT sha256(text) AS sha256, length(any_value(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(s, d):
    return dedup.dictionary_encode(table(s, d, "documents"), ["text"])[1].select("sha256", F.length("text").cast("long").alias("chars"))


@query("ranked_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(s, d):
    return dedup.ranked_page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("limit_keys", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 50")
def _(s, d):
    return dedup.limit_keys(table(s, d, "orders"), "o_custkey", 50)


@query("deterministic_sample", "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 100) UNION SELECT c_custkey FROM customer WHERE c_custkey < 5")
def _(s, d):
    return dedup.deterministic_sample(table(s, d, "customer"), "c_custkey", 100, 7, table(s, d, "customer").where("c_custkey < 5"))


@query("trigrams", """WITH g AS (SELECT DISTINCT p_partkey, substr(p_name, i, 3) AS gram FROM part, range(1, 40) r(i) WHERE i <= length(p_name) - 2) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def _(s, d):
    return table(s, d, "part").select(F.explode(T.trigrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


FULL = """FROM old FULL JOIN new ON old.id = new.id"""
ACTION = """CASE WHEN old.id IS NULL THEN 'insert' WHEN new.id IS NULL THEN CASE WHEN old.is_current THEN 'retire' ELSE 'same' END WHEN NOT old.is_current THEN 'reactivate'
WHEN old.status IS DISTINCT FROM new.status OR old.priority IS DISTINCT FROM new.priority THEN 'update' ELSE 'same' END"""
COLS = ["status", "priority"]


@query("snapshot_actions", B.sql(f"SELECT {ACTION} AS action, count(*) AS n {FULL} GROUP BY 1", "old", "new"))
def _(s, d):
    return snapshot.counts(snapshot.diff(B.old_orders(s, d), B.new_orders(s, d), ["id"], COLS))


@query("snapshot_upsert", B.sql(f"SELECT coalesce(new.id, old.id) AS id, CASE WHEN new.id IS NOT NULL THEN new.status ELSE old.status END AS status, CASE WHEN new.id IS NOT NULL THEN new.priority WHEN NOT old.is_current THEN old.priority END AS priority, new.id IS NOT NULL AS is_current, CASE WHEN new.id IS NOT NULL THEN 2 ELSE old.import_id END AS import_id {FULL}", "old", "new"))
def _(s, d):
    return snapshot.snapshot_upsert(B.old_orders(s, d), B.new_orders(s, d), ["id"], COLS, 2, clear_on_retire=["priority"])


@query("change_only_upsert", B.sql(f"SELECT coalesce(new.id, old.id) AS id, CASE WHEN new.id IS NOT NULL THEN new.status ELSE old.status END AS status, CASE WHEN new.id IS NOT NULL THEN new.priority ELSE old.priority END AS priority, new.id IS NOT NULL AS is_current, CASE WHEN {ACTION} = 'same' THEN old.import_id ELSE 2 END AS import_id {FULL}", "old", "new"))
def _(s, d):
    return snapshot.change_only_upsert(B.old_orders(s, d), B.new_orders(s, d), ["id"], COLS, 2)


@query("mirror_seed", B.sql(f"SELECT CASE WHEN old.id IS NULL THEN 'insert' WHEN new.id IS NULL THEN 'delete' WHEN old.status IS DISTINCT FROM new.status OR old.priority IS DISTINCT FROM new.priority THEN 'update' ELSE 'same' END AS action, count(*) AS n {FULL} GROUP BY 1", "old", "new"))
def _(s, d):
    return snapshot.mirror_seed(B.old_orders(s, d), B.new_orders(s, d), ["id"], COLS)[1]


@query("replace_all", "SELECT count(*) AS rows_in, count(DISTINCT (l_orderkey, l_linenumber)) AS rows_kept, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS collapsed FROM lineitem")
def _(s, d):
    return snapshot.replace_all(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])[1]


CHILDREN = """cur AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_partkey % 3 <> 0), nw AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_partkey % 4 <> 0), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)"""


def _children(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_orderkey AS k", "l_partkey AS v").distinct()
    return snapshot.replace_children(rows.where("v % 3 <> 0"), rows.where("v % 4 <> 0"), table(s, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k"), ["k"], ["k", "v"])


@query("replace_children", f"WITH {CHILDREN} SELECT k, v FROM cur WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, v FROM nw WHERE k IN (SELECT k FROM f)")
def _(s, d):
    return _children(s, d)[0]


@query("replace_children_counts", f"WITH {CHILDREN} SELECT 'insert' AS action, count(*) AS n FROM nw WHERE k IN (SELECT k FROM f) AND (k, v) NOT IN (SELECT (k, v) FROM cur) UNION ALL SELECT 'delete', count(*) FROM cur WHERE k IN (SELECT k FROM f) AND (k, v) NOT IN (SELECT (k, v) FROM nw)")
def _(s, d):
    return _children(s, d)[1]


@query("apply_redirects", """WITH i AS (SELECT p_partkey AS qid, p_name AS name FROM part WHERE p_partkey % 3 <> 2) SELECT qid, name, qid % 10 <> 1 AS is_current FROM i
UNION ALL SELECT qid + 1, name, true FROM i WHERE qid % 10 = 1 AND qid + 1 NOT IN (SELECT qid FROM i)""")
def _(s, d):
    items = table(s, d, "part").where("p_partkey % 3 <> 2").selectExpr("p_partkey AS qid", "p_name AS name", "true AS is_current")
    return snapshot.apply_redirects(items, items.where("qid % 10 = 1").selectExpr("qid AS requested", "qid + 1 AS actual"))


@query("set_mismatch", """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem WHERE l_suppkey % 5 <> 0), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem WHERE l_suppkey % 7 <> 0)
SELECT DISTINCT k FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def _(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_orderkey AS k", "l_suppkey AS v")
    return snapshot.set_mismatch(rows.where("v % 5 <> 0"), rows.where("v % 7 <> 0"), ["k"], "v")


@query("title_link_counts", """WITH n AS (SELECT DISTINCT p_partkey AS qid, p_name AS title FROM part WHERE p_partkey % 50 < 20), o AS (SELECT DISTINCT p_partkey AS qid, p_name AS title FROM part WHERE p_size < 20)
SELECT (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) AS inserted, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) AS removed""")
def _(s, d):
    rows = table(s, d, "part").selectExpr("p_partkey AS qid", "p_name AS title", "p_size")
    return articles.title_link_counts(rows.where("qid % 50 < 20"), rows.where("p_size < 20"))


@query("articles_to_fetch", "SELECT o_orderkey AS k, o_orderkey % 9 AS rev, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 END AS fetched_rev FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 9 <> o_orderkey % 8)")
def _(s, d):
    o = table(s, d, "orders")
    state = o.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 END AS fetched_rev")
    return snapshot.needs_refresh(state, o.selectExpr("o_orderkey AS k", "o_orderkey % 9 AS rev", "o_orderkey % 13 = 0 AS missing", "o_orderkey % 11 = 0 AS disambiguation"), "k")


@query("needs_refresh", "SELECT o_orderkey AS k, o_orderkey % 9 AS rev, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 END AS fetched_rev FROM orders WHERE o_orderkey % 13 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 9 <> o_orderkey % 8)")
def _(s, d):
    o = table(s, d, "orders")
    state = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS k", "o_orderkey % 8 AS fetched_rev")
    return snapshot.needs_refresh(state, o.selectExpr("o_orderkey AS k", "o_orderkey % 9 AS rev", "o_orderkey % 13 = 0 AS missing", "o_orderkey % 17 = 0 AS redirected"), "k")


@query("retire_links", B.sql(f"SELECT new.id, new.status, new.priority, CASE WHEN {ACTION} = 'same' THEN old.import_id ELSE 3 END AS import_id FROM new LEFT JOIN old ON old.id = new.id", "old", "new"))
def _(s, d):
    return snapshot.retire_links(B.old_orders(s, d), B.new_orders(s, d), "id", COLS, 3)


@query("select_titles", """WITH cur AS (SELECT DISTINCT p_name AS title FROM part WHERE p_partkey % 50 < 20), old AS (SELECT DISTINCT p_name AS title, 'Ok' AS status, length(p_name) % 2 = 0 AS is_current, CAST(1 AS BIGINT) AS import_id FROM part WHERE p_size < 20)
SELECT coalesce(cur.title, old.title) AS title, coalesce(old.status, 'Pending') AS status, cur.title IS NOT NULL AS is_current, CASE WHEN old.title IS NOT NULL AND (cur.title IS NOT NULL) = old.is_current THEN old.import_id ELSE 2 END AS import_id FROM cur FULL JOIN old ON cur.title = old.title""")
def _(s, d):
    items = table(s, d, "part").selectExpr("p_partkey AS qid", "p_name AS title", "p_partkey % 50 < 20 AS is_current")
    old = table(s, d, "part").where("p_size < 20").selectExpr("p_name AS title", "'Ok' AS status", "length(p_name) % 2 = 0 AS is_current", "CAST(1 AS BIGINT) AS import_id").distinct()
    return articles.select_titles(items, old, 2)[0]


@query("article_updates", """SELECT doc_id AS title, CASE WHEN doc_id % 7 = 0 THEN 'Missing' WHEN doc_id % 5 = 0 THEN 'Disambiguation' WHEN doc_id % 3 = 0 THEN 'ItemMismatch' WHEN doc_id % 2 = 0 THEN CASE WHEN trim(text) = '' THEN 'EmptyLead' ELSE 'Ok' END ELSE 'EmptyLead' END AS status,
CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN doc_id % 4 WHEN doc_id % 2 = 0 THEN 9 ELSE 0 END AS rev FROM documents""")
def _(s, d):
    docs = table(s, d, "documents")
    arts = docs.selectExpr("doc_id AS title", "'Pending' AS status", "CAST(NULL AS STRING) AS lead", "0L AS rev", "CAST(NULL AS TIMESTAMP) AS fetched_at")
    info = docs.selectExpr("doc_id AS title", "doc_id % 7 = 0 AS missing", "doc_id % 5 = 0 AS disambiguation", "CASE WHEN doc_id % 3 = 0 THEN 'Q1' ELSE 'Q2' END AS item", "doc_id % 4 AS rev")
    leads = docs.where("doc_id % 2 = 0").selectExpr("doc_id AS title", "text AS lead", "9L AS rev", "timestamp '2024-01-01' AS fetched_at")
    req = docs.selectExpr("doc_id AS title", "array('Q2', 'Q3') AS qids")
    return articles.apply_article_updates(arts, info, leads, req).select("title", "status", "rev")


@query("rows_fingerprint", """SELECT count(*) AS rows, CAST(sum(CAST('0x' || md5(o_orderkey || chr(31) || o_custkey || chr(31) || coalesce(o_orderstatus, chr(30)) || chr(31) || coalesce(o_orderpriority, chr(30)))[1:8] AS BIGINT)) AS BIGINT) AS checksum FROM orders""")
def _(s, d):
    return rows_fingerprint(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("latest_revisions", "SELECT DISTINCT ON (conv_id) conv_id, turn, role FROM conversations ORDER BY conv_id, turn DESC")
def _(s, d):
    from quernstone.streaming.landing import merge_revisions

    rows = table(s, d, "conversations").select("conv_id", "turn", "role")
    return merge_revisions(merge_revisions(None, rows.where("turn % 2 = 0"), "conv_id", "turn"), rows, "conv_id", "turn")


# Facts are events, the distribution is made of orders
@query("fact_summary", B.sql("""SELECT 'rank' AS metric, rank AS value, count(*) AS n FROM taxa WHERE is_current GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM taxa WHERE is_current GROUP BY 2
UNION ALL SELECT 'taxa', CASE WHEN is_current THEN 'current' ELSE 'retired' END, count(*) FROM taxa GROUP BY 2
UNION ALL SELECT 'trait', CASE event_type WHEN 'click' THEN 'k_click' WHEN 'view' THEN 'k_view' ELSE event_type END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'kind', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'scheme', o_orderpriority, count(*) FROM orders GROUP BY 2""", "taxa"))
def _(s, d):
    types = s.createDataFrame([("click", "k_click"), ("view", "k_view")], "type_uri string, key string")
    distribution = table(s, d, "orders").selectExpr("o_orderstatus AS kind", "o_orderpriority AS scheme")
    return profile.fact_summary(B.taxa(s, d), table(s, d, "events").selectExpr("event_type AS type_uri"), types, distribution)


# A6
@query("malformed_ids", """WITH b AS (SELECT 'bad-' || p_size AS e FROM part WHERE p_partkey % 10 = 0)
SELECT (SELECT count(*) FROM b) AS malformed, (SELECT string_agg(e, '|' ORDER BY e) FROM (SELECT DISTINCT e FROM b ORDER BY e LIMIT 20)) AS examples""")
def _(s, d):
    k = F.col("p_partkey")
    raw = F.when(k % 10 == 0, F.concat(F.lit("bad-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("wfo-"), F.lpad(k.cast("string"), 10, "0")))
    return profile.malformed_ids(table(s, d, "part").select(raw.alias("taxon_id_raw")))


# A9
@query("unknown_types", "SELECT event_type AS type_uri, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _(s, d):
    types = s.createDataFrame([("click",), ("view",)], "type_uri string")
    return profile.unknown_types(table(s, d, "events").selectExpr("event_type AS type_uri"), types)


# A8
@query("unlabelled_places", "SELECT 'geonames' AS scheme, CAST(s_nationkey AS VARCHAR) AS place_id, count(*) AS n FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) GROUP BY 2")
def _(s, d):
    distribution = table(s, d, "supplier").selectExpr("CASE WHEN s_suppkey % 4 = 0 THEN 'literal' ELSE 'geonames' END AS scheme", "CAST(s_nationkey AS STRING) AS place_id")
    places = table(s, d, "nation").where("n_nationkey % 3 = 0").selectExpr("'geonames' AS scheme", "CAST(n_nationkey AS STRING) AS place_id")
    return profile.unlabelled_places(distribution, places)


# A13
@query("link_totals", B.sql("""SELECT o_orderstatus AS status, o_orderpriority AS method, count(*) AS n, count(CASE WHEN t.status = 'Synonym' THEN 1 END) AS to_synonym, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS with_accepted
FROM orders LEFT JOIN taxa t ON t.taxon_id = o_custkey GROUP BY 1, 2""", "taxa"))
def _(s, d):
    links = table(s, d, "orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS method", "o_custkey AS taxon", "CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS accepted")
    return profile.link_totals(links, B.taxa(s, d))


# Symbols that an external id leads to, by the status of their link
@query("symbols_with_ext_id", "SELECT o_orderstatus AS status, count(*) AS symbols, count(CASE WHEN o_custkey % 3 = 0 THEN 1 END) AS with_ext_id FROM orders GROUP BY 1")
def _(s, d):
    links = table(s, d, "orders").selectExpr("o_orderstatus AS status", "o_custkey AS symbol")
    ids = table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS value", "c_custkey AS qid")
    return profile.symbols_with_ext_id(links, ids.unionByName(ids))


# A7, A3
@query("counts_of_current", B.sql("SELECT language, count(*) AS n FROM names JOIN taxa ON taxon_id = qid WHERE is_current GROUP BY 1", "names", "taxa"))
def _(s, d):
    return profile.counts_of_current(B.taxa(s, d).selectExpr("taxon_id AS qid", "is_current"), B.names(s, d), "language")


@query("snapshot_groups", B.sql("SELECT 'rank' AS field, rank AS value, count(*) AS n FROM taxa WHERE is_current GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM taxa WHERE is_current GROUP BY 2", "taxa"))
def _(s, d):
    return profile.snapshot_groups(B.taxa(s, d), ["rank", "status"]).select(F.col("field"), F.col("value"), "n")


# A number of one statistic, which must be the only one, and a number that all facts must share. The facts of a
# customer are the prices of the orders, with their priority as statistic, and a number that one order in forty has wrong.
@query("compare_numbers", """WITH o AS (SELECT o_custkey AS symbol, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent, count(*) FILTER (WHERE o_orderkey % 40 = 0) AS odd FROM orders GROUP BY 1)
SELECT c_custkey AS symbol, 'Mean' AS field, 'Statistic' AS mode, CASE WHEN coalesce(urgent, 0) = 0 THEN 'Missing' WHEN urgent = 1 AND c_custkey % 2 = 0 THEN 'Agree' ELSE 'Disagree' END AS outcome FROM customer LEFT JOIN o ON symbol = c_custkey
UNION ALL SELECT c_custkey, 'Sole', 'Only', CASE WHEN odd IS NULL THEN 'Missing' WHEN odd = 0 THEN 'Agree' ELSE 'Disagree' END FROM customer LEFT JOIN o ON symbol = c_custkey""")
def _(s, d):
    orders, nothing = table(s, d, "orders"), F.lit(None).cast("string")
    common = [nothing.alias("label"), F.lit("verified").alias("confidence")]
    prices = orders.select(F.col("o_custkey").alias("symbol"), F.lit("k_price").alias("key"), *common, F.col("o_totalprice").cast("decimal(38,15)").alias("numeric"), F.col("o_orderpriority").alias("statistic"))
    sole = F.col("o_custkey") % 7 + F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)
    ours = prices.unionByName(orders.select(F.col("o_custkey").alias("symbol"), F.lit("k_sole").alias("key"), *common, sole.cast("decimal(38,15)").alias("numeric"), nothing.alias("statistic")))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max(F.col("o_totalprice").cast("decimal(20,2)")).alias("most"))
    people = table(s, d, "customer").select(F.col("c_custkey").alias("symbol")).join(urgent, "symbol", "left")
    mean = F.when(F.col("symbol") % 2 == 0, F.coalesce(F.col("most").cast("string"), F.lit("1"))).otherwise("1")
    theirs = people.select("symbol", F.lit("mEAN").alias("field"), mean.alias("value")).unionByName(people.select("symbol", F.lit("sole").alias("field"), F.concat((F.col("symbol") % 7).cast("string"), F.lit(".0")).alias("value")))
    mapping = s.createDataFrame([("Mean", "k_price", "Statistic", "1-URGENT"), ("Sole", "k_sole", "Only", None)], "field string, key string, mode string, statistic string")
    return facts.compare_facts(ours, theirs, mapping).select("symbol", "field", "mode", "outcome")
