"""Placement by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a row draws one score for each child, -ln(u) / weight with u from a keyed hash of the child's
path and the row's key, and descends into the child with the least. A child is drawn in proportion to its
weight, and when one child's weight changes, rows move only into or out of that child's subtree. All of it
is SQL functions on the main path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
SLOT_DIGITS = 3  # hexadecimal digits of the hash that part a shard for numbering: 4096 parts


def tree_of(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Equal shards in racks and regions; a further shard that finds all regions full opens a region of its own."""
    tree: Tree = {}
    for s in range(shards):
        region, place = divmod(s, per_rack * racks)
        tree.setdefault(f"r{region}", {}).setdefault(f"r{region}k{place // per_rack}", {})[s] = 1.0
    return tree


def _weight(node) -> float:
    return float(sum(map(_weight, node.values()))) if isinstance(node, dict) else float(node)


def _score(path: str, weight: float, key: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{path}|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / F.lit(weight)


def descend(key: Column, node: dict, seed: str) -> Column:
    """The leaf that a key draws. Children without weight are never drawn; a lone child needs no draw."""
    live = {str(name): child for name, child in node.items() if _weight(child) > 0}
    if not live:
        raise ValueError("no child has weight")
    leaf = {name: child if isinstance(child, dict) else None for name, child in live.items()}
    end = lambda name: descend(key, leaf[name], seed) if leaf[name] is not None else F.lit(int(name))
    if len(live) == 1:
        return end(next(iter(live)))
    draws = [
        F.struct(_score(name, _weight(child), key, seed).alias("s"), F.lit(i).alias("i"))
        for i, (name, child) in enumerate(live.items())
    ]
    pick, out = F.array_min(F.array(*draws)).getField("i"), None
    for i, name in enumerate(live):
        out = F.when(pick == i, end(name)) if out is None else out.when(pick == i, end(name))
    return out


def shard(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "caseweave",
) -> DataFrame:
    """One row for each input row: id, size, text_crc32, shard, slot and, with a `grown` tree, grown_shard.

    The id alone decides the shard, so rows that repeat an id share one; null ids count as one key. A null
    text has no bytes (size 1, checksum 0). Slots number a shard's rows without gaps from 0, in the order of
    the id's hash; among rows with the same id the order is by checksum and size. Numbering counts rows by
    shard and hash prefix first, so no task sorts a whole shard. Other columns are ignored; an empty table
    gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))
    rank = F.md5(F.concat(F.lit(f"{seed}|slot|"), key))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, tree, seed).cast("int").alias("shard"),
        (descend(key, grown, seed) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        rank.alias("rank"),
        F.substring(rank, 1, SLOT_DIGITS).alias("part"),
    )
    counts = placed.groupBy("shard", "part").count()  # reads ids alone; at most 4096 rows a shard
    before = counts.selectExpr(
        "shard AS _s", "part AS _p", "sum(count) OVER (PARTITION BY shard ORDER BY part) - count AS ahead"
    )
    numbered = placed.selectExpr(
        "*", "row_number() OVER (PARTITION BY shard, part ORDER BY rank, text_crc32, size) - 1 AS within"
    )
    out = numbered.join(before, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    slot = (F.col("ahead") + F.col("within")).cast("long").alias("slot")
    return out.select("id", "size", "text_crc32", "shard", slot, "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), tree_of(8), tree_of(9))
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _sql_draw(node: dict, seed: str = "caseweave") -> str:
    live = {str(n): c for n, c in node.items()}
    end = lambda n: _sql_draw(live[n], seed) if isinstance(live[n], dict) else n
    if len(live) == 1:
        return end(next(iter(live)))
    score = lambda n: f"-ln((('0x' || substr(md5('{seed}|{n}|' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {_weight(live[n])}"  # noqa: E731, E501
    pick = "list_min([" + ", ".join(f"{{'s': {score(n)}, 'i': {i}}}" for i, n in enumerate(live)) + "]).i"
    return f"(CASE {pick} " + " ".join(f"WHEN {i} THEN {end(n)}" for i, n in enumerate(live)) + " END)"


SQL = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '\\N') AS k, encode(coalesce(text, '')) AS b FROM documents
), c AS (
  SELECT doc_id, k, octet_length(b)::BIGINT + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)])))::BIGINT AS text_crc32,
    {_sql_draw(tree_of(8))}::INT AS shard, {_sql_draw(tree_of(9))}::INT AS grown_shard
  FROM d, t
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('caseweave|slot|' || k), text_crc32, size) - 1 AS slot, grown_shard
FROM c
"""
