"""Digests of large row sets as hash trees: one root for all rows, and the way down to what differs.

Rows fall into leaves by the first hexadecimal digits of their SHA-256, so leaves are equally full whatever the rows
are, equal trees mean equal sets of rows (with multiplicity), and a changed row changes one path only. Repeated rows are
counted before they are gathered: a row that fills the table is one entry of its leaf.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.session import stored

LEAF_ROWS = 1_000
NODE = ["level", "prefix", "digest", "rows"]


def row_hash(*values: Column) -> Column:
    """SHA-256 of a row: each value with its length, nulls told from empty texts."""
    texts = [v.cast("string") for v in values]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*marked), 256)


def tree_depth(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / leaf_rows, 16)))


def _nodes(entries: DataFrame, level: int, key: Column, entry: Column) -> DataFrame:
    """Nodes over sorted entries; a node has at most 16 children, a leaf as many rows as hashing puts there."""
    grouped = entries.groupBy(key.alias("prefix")).agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.sum("rows").alias("rows"))
    text = F.array_join(F.transform("_e", lambda e: F.concat(e["name"], F.lit(":"), e["value"])), ",")
    return grouped.select(F.lit(level).alias("level"), "prefix", F.sha2(text, 256).alias("digest"), F.col("rows").cast("bigint").alias("rows"))


def hash_tree(hashes: DataFrame, depth: int, column: str = "h") -> DataFrame:
    """``level, prefix, digest, rows`` of every node; level 0 is the root, ``depth`` the leaves. No rows, no nodes."""
    counted = hashes.groupBy(F.col(column).alias("h")).agg(F.count(F.lit(1)).alias("rows"))
    entry = F.struct(F.col("h").alias("name"), F.col("rows").cast("string").alias("value"))
    level = stored(_nodes(counted, depth, F.substring("h", 1, depth), entry), "tree-leaves")
    out = level
    for n in range(depth - 1, -1, -1):
        child = F.struct(F.col("prefix").alias("name"), F.col("digest").alias("value"))
        level = _nodes(level, n, F.substring("prefix", 1, n) if n else F.lit(""), child)
        out = out.unionByName(level)
    return out


def root_digest(tree: DataFrame) -> str | None:
    found = tree.filter("level = 0").select("digest").first()
    return found["digest"] if found else None


def differing_leaves(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """Prefixes of leaves that differ between two trees of one depth, found from the root down.

    On every level only children of nodes that differ are compared; equal trees are done at their roots.
    """
    above = None
    for level in range(depth + 1):
        sides = []
        for name, tree in (("a", left), ("b", right)):
            nodes = tree.filter(F.col("level") == level).select("prefix", F.col("digest").alias(name))
            if above is not None:
                parent = F.substring("prefix", 1, level - 1) if level > 1 else F.lit("")
                nodes = nodes.withColumn("_up", parent).join(above.withColumnRenamed("prefix", "_up"), "_up", "left_semi").drop("_up")
            sides.append(nodes)
        both = sides[0].join(sides[1], "prefix", "full").filter("NOT (a <=> b)")
        above = stored(both.select("prefix"), "tree-differs")
        if above.isEmpty():
            break
    return above


def differing_rows(left: DataFrame, right: DataFrame, leaves: DataFrame, depth: int, column: str = "h") -> DataFrame:
    """``h, left_count, right_count`` of the rows that differ, read from the differing leaves only."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col(column).alias("h")).withColumn("prefix", F.substring("h", 1, depth))
        return own.join(leaves, "prefix", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias(name))

    met = counts(left, "left_count").join(counts(right, "right_count"), "h", "full")
    filled = met.select("h", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_count", "right_count")])
    return filled.filter("left_count <> right_count")
