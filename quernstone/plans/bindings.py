"""The library's logical tables as plain selections from the star-schema tables.

Each selection is one text that Spark and the comparison engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import compact_name, with_normalized
from quernstone.session import table

TAXA = """p_partkey AS taxon_id, p_name AS name, p_type AS genus, p_brand AS family,
CASE p_size % 4 WHEN 0 THEN 'genus' WHEN 1 THEN 'species' WHEN 2 THEN 'variety' ELSE 'nothospecies' END AS rank,
CASE p_partkey % 3 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Synonym' ELSE 'Unchecked' END AS status,
CASE WHEN p_partkey % 3 = 1 THEN p_partkey - 1 END AS accepted_id,
CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1500 ELSE p_partkey - 3 END AS parent_id, p_partkey % 11 <> 0 AS is_current"""
NAMES = """p_partkey AS qid, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'en-gb' ELSE 'fr' END AS language,
p_brand || ' ' || replace(p_name, ' ', '-') AS name"""
ITEM_LINKS = """p_partkey AS qid, p_partkey AS taxon,
CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey - 1 END AS accepted"""
# in every 2000 keys chains along steps of 10 that end at multiples of 100, a cycle of two, one of itself, and a long
# chain, so that edges and broken chains grow with the table; the long chain's hundred has no others
EDGES = """p_partkey AS old_id, CASE WHEN p_partkey % 2000 = 4 THEN p_partkey + 1 WHEN p_partkey % 2000 = 5 THEN p_partkey - 1 WHEN p_partkey % 2000 = 6 THEN p_partkey
WHEN p_partkey % 2000 BETWEEN 1000 AND 1070 THEN p_partkey + 1 ELSE p_partkey - p_partkey % 10 + CASE WHEN p_partkey % 10 = 0 THEN -10 ELSE 0 END END AS new_id"""
EDGES_WHERE = "p_partkey % 2000 BETWEEN 1000 AND 1070 OR p_partkey % 100 <> 0 AND NOT p_partkey % 2000 BETWEEN 1071 AND 1099"
FACTS = """event_id AS row_no, user_id AS symbol, event_type AS type_uri, event_type AS code, CAST(value AS VARCHAR(40)) AS value_raw, value AS numeric"""
OLD_ORDERS = "o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey % 5 <> 0 AS is_current, CAST(1 AS BIGINT) AS import_id"
OLD_ORDERS_WHERE = "o_orderkey % 4 <> 1"
NEW_ORDERS = "o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority"
NEW_ORDERS_WHERE = "o_orderkey % 7 <> 2"


def _exprs(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    text = text.replace("\n", " ").replace("VARCHAR(40)", "STRING")
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def bound(spark: SparkSession, sf_dir: str, source: str, text: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, source).where(where).selectExpr(*_exprs(text))


def taxa(spark, d):
    return bound(spark, d, "part", TAXA)


def names(spark, d):
    n = with_normalized(bound(spark, d, "part", NAMES), "name", "normalized")
    return n.withColumn("compact", compact_name(F.col("normalized")))


def item_links(spark, d):
    return bound(spark, d, "part", ITEM_LINKS)


def edges(spark, d):
    return bound(spark, d, "part", EDGES, EDGES_WHERE)


def old_orders(spark, d):
    return bound(spark, d, "orders", OLD_ORDERS, OLD_ORDERS_WHERE)


def new_orders(spark, d):
    return bound(spark, d, "orders", NEW_ORDERS, NEW_ORDERS_WHERE)


CTES = {
    "taxa": f"SELECT {TAXA} FROM part",
    "names": f"SELECT *, lower(name) AS normalized, replace(replace(lower(name), ' ', ''), '-', '') AS compact FROM (SELECT {NAMES} FROM part)",
    "item_links": f"SELECT {ITEM_LINKS} FROM part",
    "edges": f"SELECT {EDGES} FROM part WHERE {EDGES_WHERE}",
    "old": f"SELECT {OLD_ORDERS} FROM orders WHERE {OLD_ORDERS_WHERE}",
    "new": f"SELECT {NEW_ORDERS} FROM orders WHERE {NEW_ORDERS_WHERE}",
}


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    with_ = ", ".join(f"{c} AS ({CTES[c]})" for c in ctes)
    body = body.strip()
    if not with_:
        return body
    if body.startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{with_}, {body[5:]}"
    return f"WITH {with_} {body}"
