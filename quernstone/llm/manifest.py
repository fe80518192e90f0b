"""A Merkle manifest of a dataset: cogrouped subtree exchange.

Leaves are hashed by Spark and numbered within their source by two levels of counts. Every ``ARITY ** LEVELS``
consecutive leaves of a source are a superblock.

* Up: superblocks are reduced to one node each, these again in superblocks of their own, until a source has one node,
  its subroot; the subroots are reduced in the same way to the root.
* Down: the other nodes of each run on the way from a superblock's node to the root are what the superblock needs from
  outside. They are found a layer at a time, by cogrouping a layer's nodes with what its superblocks need.
* Exchange: leaves and the outer nodes that they need are cogrouped by superblock, and one function reduces the leaves
  once more, joins each leaf's siblings to the outer ones, hashes the proof and folds the tampered leaf up to the root.

No group is larger than a superblock. Outer nodes are a few kilobytes a superblock of 4096 leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import written

ARITY = 16
LEVELS = 3  # that a superblock reduces
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# The letters that tampering changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NODE = "rank long, pos long, digest string"
# lefts and rights: for each level upwards the digests before and after the own one in its run
OUTER = "rank long, block long, lefts array<string>, rights array<string>"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z as a-z; for plain ASCII that is lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for c in columns.values():
        t = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of every row; ``tampered`` is null where nothing is changed.

    Texts stay behind: only digests are moved from here on.
    """
    own = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = lower_ascii(F.col("text"))
    changed = F.when(chosen & (low != F.col("text")), leaf(own | {"text": low}))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(own).alias("leaf"), changed.alias("tampered"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with rank (of their source: null first, then bytewise) and pos; and (rank, n) of each source.

    Leaves of a source are in the order of doc_id (null first), those that repeat an id in the order of the digest.
    Rows are dealt by ranges of that order, so a hot source takes many tasks; a table keeps which row came to which.
    ``rows`` are written first: finding the ranges reads them once more, and texts must not be hashed twice.
    """
    rows = written(rows, "hashed")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"))
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "leaves")
    per = written(dealt.groupBy("source", "part").agg(F.count("*").alias("c")), "counts")
    totals = per.groupBy("source").agg(F.sum("c").alias("n"))
    ranks = totals.select("source", "n", (F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))) - 1).cast("long").alias("rank"))
    ranks = written(ranks, "ranks")
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("c").over(upto), F.lit(0))).drop("c")
    keys = per.join(ranks, per.source.eqNullSafe(ranks.source)).select(per.source.alias("__s"), F.col("part").alias("__p"), "__before", "rank")
    keys = written(keys, "keys")
    nth = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.asc_nulls_first("doc_id"), "leaf"))
    local = dealt.withColumn("__k", nth - 1)
    out = local.join(keys, local.source.eqNullSafe(keys["__s"]) & (local.part == F.col("__p")))
    return out.select("doc_id", "leaf", "tampered", "rank", (F.col("__k") + F.col("__before")).cast("long").alias("pos")), ranks.select("rank", "n")


def depth_of(n: int, arity: int) -> int:
    """Levels from ``n`` nodes to one."""
    d = 0
    while n > 1:
        n, d = -(-n // arity), d + 1
    return d


def joined(digests: list[str], arity: int) -> list[str]:
    """The digests of every ``arity`` consecutive ones."""
    return [sha256("".join(digests[i : i + arity]).encode()).hexdigest() for i in range(0, len(digests), arity)]


def reduced(nodes: DataFrame, sizes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One node a superblock of ``nodes`` (rank, pos, digest); a rank of one superblock stops at one node."""
    block = arity**levels

    def up(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("pos")
        level = table["digest"].tolist()
        for _ in range(levels if table["n"].iat[0] > block else depth_of(len(level), arity)):
            level = joined(level, arity)
        return pd.DataFrame({"rank": table["rank"].iloc[:1], "pos": table["block"].iloc[:1], "digest": level})

    rows = nodes.join(sizes, "rank").withColumn("block", F.floor(F.col("pos") / block))
    return rows.groupBy("rank", "block").applyInPandas(up, NODE)


def layers(nodes: DataFrame, sizes: DataFrame, arity: int, levels: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The layers above ``nodes``, each with its sizes, up to one node a rank; and those nodes."""
    block, out = arity**levels, []
    while True:
        out.append((nodes, sizes))
        most = sizes.agg(F.max("n").alias("m")).first().m or 0
        nodes = written(reduced(nodes, sizes, arity, levels), "nodes")
        if most <= block:
            return out, nodes
        sizes = written(sizes.select("rank", F.ceil(F.col("n") / block).alias("n")), "sizes")


def siblings(digests: list[str], n: int, arity: int, levels: int) -> list[tuple[list[str], list[str]]]:
    """For each node of a superblock, the digests before and after it in its run, joined, for each level upwards.

    ``n`` is the size of its rank's layer: a rank of one superblock has only as many levels as it needs.
    """
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in digests]
    level, width = digests, 1
    for _ in range(levels if n > arity**levels else depth_of(len(digests), arity)):
        for i, (left, right) in enumerate(out):
            at = i // width
            run = at - at % arity
            left.append("".join(level[run:at]))
            right.append("".join(level[at + 1 : run + arity]))
        level, width = joined(level, arity), width * arity
    return out


def outer_nodes(layer: list[tuple[DataFrame, DataFrame]], top: DataFrame, arity: int, levels: int) -> DataFrame:
    """What each superblock of the lowest layer needs from outside; ``top`` is what each rank's one node needs."""
    block = arity**levels
    need = top
    for nodes, sizes in reversed(layer[1:]):

        def down(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("pos")
            found = siblings(own["digest"].tolist(), int(own["n"].iat[0]), arity, levels)
            left, right = list(above["lefts"].iat[0]), list(above["rights"].iat[0])
            return pd.DataFrame({"rank": own["rank"], "block": own["pos"], "lefts": [[*a, *left] for a, _ in found], "rights": [[*b, *right] for _, b in found]})

        rows = nodes.join(sizes, "rank").withColumn("block", F.floor(F.col("pos") / block))
        need = written(rows.groupBy("rank", "block").cogroup(need.groupBy("rank", "block")).applyInPandas(down, OUTER), "outer")
    return need


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are not read. Nulls are values of their own: a
    null source is a source, a null id is hashed as ``-`` and never tampered with. Rows that repeat are leaves of their
    own, next to each other. A single row is leaf, subroot and root at once, with the empty proof. An empty table gives
    no rows. A text is hashed whole, in the task that reads it.
    """
    spark = docs.sparkSession
    block = arity**levels
    rows, sizes = numbered(leaves(docs))
    rows, sizes = written(rows, "numbered"), written(sizes, "sizes")
    own, subroots = layers(rows.select("rank", "pos", F.col("leaf").alias("digest")), sizes, arity, levels)
    # the subroots are the leaves of a tree of their own, whose one rank is 0
    upper = subroots.select(F.lit(0).cast("long").alias("rank"), F.col("rank").alias("pos"), "digest")
    n_sources = sizes.count()
    count = spark.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(n_sources).cast("long").alias("n"))
    above, root = layers(upper, count, arity, levels)
    nothing = F.array().cast("array<string>")
    root_need = spark.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("block"), nothing.alias("lefts"), nothing.alias("rights"))
    root_need = root_need.where(F.lit(n_sources > 0))  # an empty table has no root
    # one layer more: the nodes that every subroot needs
    lowest = outer_nodes([(upper.limit(0), count), *above], root_need, arity, levels)
    top = lowest.select(F.col("block").alias("rank"), F.lit(0).cast("long").alias("block"), "lefts", "rights")
    need = outer_nodes(own, top, arity, levels)
    (whole,) = [r.digest for r in root.collect()] or [""]  # one node
    ends = subroots.select("rank", F.col("digest").alias("subroot"))
    need = written(need.join(ends, "rank").join(sizes, "rank"), "needed")

    def exchange(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        left, right = list(outer["lefts"].iat[0]), list(outer["rights"].iat[0])
        beyond = "".join(a + b for a, b in zip(left, right, strict=True))
        digests = own["leaf"].tolist()
        found = siblings(digests, int(outer["n"].iat[0]), arity, levels)
        proofs, folded = [], []
        for now, (a, b) in zip(own["tampered"].where(own["tampered"].notna(), own["leaf"]), found, strict=True):
            proofs.append(sha256(("".join(x + y for x, y in zip(a, b, strict=True)) + beyond).encode()).hexdigest())
            for x, y in zip([*a, *left], [*b, *right], strict=True):
                now = sha256((x + now + y).encode()).hexdigest()
            folded.append(now)
        return pd.DataFrame({"doc_id": own["doc_id"], "leaf": digests, "subroot": outer["subroot"].iat[0], "root": whole, "proof_sha256": proofs, "folded_root": folded, "verified": [x == whole for x in folded]})

    rows = rows.withColumn("block", F.floor(F.col("pos") / block))
    return rows.groupBy("rank", "block").cogroup(need.groupBy("rank", "block")).applyInPandas(exchange, RESULT)


def op12(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; see the contract of this operator."""
    return manifest(docs)


def _tree_sql(name: str, base: str, levels: int) -> str:
    """CTEs <name>0, <name>1, ... of the nodes (r, p, h, n) of each level from ``base`` (r, p, h), for comparison SQL;
    ``n`` is the number of the rank's nodes there. Nodes of a level of one are ends and have no level above."""
    out = [f"{name}0 AS (SELECT r, p, h, count(*) OVER (PARTITION BY r) AS n FROM {base})"]
    for k in range(levels):
        below = f"SELECT r, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k} WHERE n > 1 GROUP BY r, p // 16"
        out.append(f"{name}{k + 1} AS (SELECT r, p, h, count(*) OVER (PARTITION BY r) AS n FROM ({below}))")
    for k in range(levels):
        run = "PARTITION BY r, p // 16 ORDER BY p ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT r, p, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k} WHERE n > 1)")
    return ",\n".join(out)


def _manifest_sql(levels: int = 5, above: int = 3) -> str:
    """Comparison SQL for at most 16 ** levels leaves a source and 16 ** above sources."""

    def fields(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values)

    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    low = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END"
    ends = " UNION ALL ".join(f"SELECT r, h FROM l{k} WHERE n = 1" for k in range(levels + 1))
    tops = " UNION ALL ".join(f"SELECT h FROM u{k} WHERE n = 1" for k in range(above + 1))
    way = [(f"ls{k}", "i.r", f"i.p // {16**k}") for k in range(levels)] + [(f"us{k}", "0", f"i.r // {16**k}") for k in range(above)]
    joins = " ".join(f"LEFT JOIN {t} ON {t}.r = {r} AND {t}.p = {p}" for t, r, p in way)
    pairs = []
    select = ["i.doc_id", "i.h AS leaf", "e.h AS subroot", "t.h AS root"]
    for k, (t, _, _) in enumerate(way):
        pairs.append(f"coalesce({t}.a || {t}.b, '')")
        select += [f"{t}.a AS a{k}", f"{t}.b AS b{k}"]
    inner = f"SELECT {', '.join(select)}, {' || '.join(pairs)} AS around, changed AS f0 FROM i JOIN e ON e.r = i.r CROSS JOIN t {joins}"
    for k in range(len(way)):
        inner = f"SELECT *, CASE WHEN a{k} IS NULL THEN f{k} ELSE sha256(a{k} || f{k} || b{k}) END AS f{k + 1} FROM ({inner})"
    out = f"SELECT doc_id, leaf, subroot, root, sha256(around) AS proof_sha256, f{len(way)} AS folded_root, f{len(way)} = root AS verified FROM ({inner})"
    return f"""WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS r, sha256({fields('text')}) AS h, sha256({fields(f'({low})')}) AS changed FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
{_tree_sql('l', 'i', levels)},
e AS ({ends}),
s AS (SELECT 0 AS r, r AS p, h FROM e),
{_tree_sql('u', 's', above)},
t AS ({tops})
{out}"""


OP12_SQL = _manifest_sql()
