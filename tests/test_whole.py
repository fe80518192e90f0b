"""Queries over whole tables against brute force on a generated ``part`` table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.operators import resolve
from quernstone.plans import bindings as B
from quernstone.plans import queries as Q

N = 4100


@pytest.fixture(scope="module")
def part(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = spark.range(1, N + 1).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'t' AS p_type", "'b' AS p_brand", "CAST(id % 50 AS INT) AS p_size")
    rows.write.parquet(f"{folder}/part.parquet")
    return folder


def chains(edges, ids, current):
    """(resolved, status) of each id, edge by edge."""
    step, out = {r.old_id: r.new_id for r in edges.collect()}, {}
    for i in ids:
        node, seen, again = i, [i], False
        while node in step and not again and len(seen) <= resolve.MAX_DEPTH + 1:
            node = step[node]
            again = node in seen
            seen.append(node)
        if again:
            out[i] = node, "Cycle"
        elif len(seen) > resolve.MAX_DEPTH + 1:
            out[i] = None, "DepthLimit"
        else:
            out[i] = node, "Resolved" if node in current else "NotFound"
    return out


@pytest.fixture(scope="module")
def taxa(spark, part):
    return {r.taxon_id: r for r in B.taxa(spark, part).collect()}


def test_item_links_of_all_taxa(spark, part, taxa):
    current = {k for k, r in taxa.items() if r.is_current}
    chain = chains(B.edges(spark, part), taxa, current)
    want = set()
    for i in taxa:
        resolved, status = chain[i]
        if i % 13 == 0:
            want.add((i, None, None, None, "NotFound"))
            continue
        taxon = resolved if status == "Resolved" else None
        t = taxa.get(taxon)
        accepted = None if t is None else taxon if t.status == "Accepted" else t.accepted_id if t.status == "Synonym" and t.accepted_id in current else None
        want.add((i, resolved, taxon, accepted, status))
    assert {tuple(r) for r in Q.QUERIES["resolve_item_links"](spark, part).collect()} == want
    assert len(want) == N


def test_detail_of_all_taxa(spark, part, taxa):
    current = {k for k, r in taxa.items() if r.is_current}
    want = set()
    for i, (resolved, _) in chains(B.edges(spark, part), taxa, current).items():
        t = taxa[resolved] if resolved in current else None
        a = t.accepted_id if t is not None and t.accepted_id in current else None
        p = t.parent_id if t is not None and t.parent_id in current else None
        want.add((i, resolved, t and t.name, a, a and taxa[a].name, p and taxa[p].name))
    assert {tuple(r) for r in Q.QUERIES["taxon_detail"](spark, part).collect()} == want
    assert len(want) == N


def test_detail_of_a_chain_that_is_too_long(spark, part):
    edges = spark.range(65).selectExpr("id AS old_id", "id + 1 AS new_id")
    ids = spark.range(2).selectExpr("id")
    t = B.taxa(spark, part).withColumn("is_current", F.lit(True)).withColumnRenamed("status", "taxonomic_status")
    assert {(r.id, r.status, r.name) for r in resolve.taxon_detail(ids, edges, t, []).collect()} == {(0, "DepthLimit", None), (1, "Resolved", "n65")}


def test_edges_and_broken_chains_grow_with_the_table(spark, part, taxa):
    current = {k for k, r in taxa.items() if r.is_current}
    chain = chains(B.edges(spark, part), taxa, current)
    got = Q.QUERIES["resolve_chain"](spark, part).collect()
    assert {(r.id, r.resolved, r.status, r.was_redirected) for r in got} == {(i, node, status, node != i) for i, (node, status) in chain.items()}
    cycles = sorted(i for i, (_, status) in chain.items() if status == "Cycle")
    long = sorted(i for i, (_, status) in chain.items() if status == "DepthLimit")
    assert cycles == [b + i for b in (0, 2000, 4000) for i in (4, 5, 6)] and long == [b + i for b in (0, 2000) for i in range(1000, 1007)]
    assert Q.QUERIES["validate_chain_graph"](spark, part).collect() == [(len(cycles), len(long))]
