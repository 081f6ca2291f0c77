"""A digest tree of a frozen set, and the difference of two sets by descending it.

Rows are dealt to leaves by the first hex digits of their key's SHA-256, so the tree is the same for any
partitioning and any type of key, and no leaf is crowded by keys that lie together. A leaf's digest is that of its
rows' digests in order; a node's is that of the digests below it. One digest stands for the whole set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digested(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """key (as text, null as an empty text with a mark), path (hex of its SHA-256) and digest of every row."""
    said = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    return rows.select(said.alias("key"), F.sha2(said, 256).alias("path"), F.sha2(F.concat(said, F.lit("\n"), F.coalesce(value.cast("string"), F.lit(""))), 256).alias("digest"))


def joined(digest: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256)


def digest_tree(rows: DataFrame, digits: int = 4) -> DataFrame:
    """level, node (hex digits), n and digest of every node, from the root (level 0, '') to the leaves, from
    ``digested`` rows. A leaf holds 16 ** -digits of them: choose enough digits for some thousands in each. An empty set
    has a root of its own."""
    leaf = rows.groupBy(F.substring("path", 1, digits).alias("node")).agg(F.count(F.lit(1)).alias("n"), joined("digest").alias("digest"))
    levels = [leaf.select(F.lit(digits).alias("level"), "node", "n", "digest")]
    for level in range(digits - 1, 0, -1):
        below = levels[-1].groupBy(F.substring("node", 1, level).alias("node"))
        named = F.array_sort(F.collect_list(F.struct("node", "digest")))
        made = below.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(named, lambda x: F.concat(x["node"], x["digest"])), ""), 256).alias("digest"))
        levels.append(made.select(F.lit(level).alias("level"), "node", "n", "digest"))
    named = F.array_sort(F.collect_list(F.struct("node", "digest")))
    root = levels[-1].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(named, lambda x: F.concat(x["node"], x["digest"])), ""), 256).alias("digest"))
    levels.append(root.select(F.lit(0).alias("level"), F.lit("").alias("node"), "n", "digest"))
    whole = levels[0]
    for one in levels[1:]:
        whole = whole.unionByName(one)
    return whole


def differing_leaves(before: DataFrame, after: DataFrame, digits: int = 4) -> DataFrame:
    """The leaves in which two trees (written tables) differ: from the root down, only what is below a differing node is
    compared; equal sets end at the root."""
    spark = before.sparkSession
    open_nodes = spark.createDataFrame([("",)], "node string")
    for level in range(digits + 1):
        pick = lambda tree, name: tree.filter(F.col("level") == level).select("node", F.col("digest").alias(name))  # noqa: B023, E731
        above = F.substring("node", 1, max(level - 1, 0))
        both = pick(before, "a").join(pick(after, "b"), "node", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = both.withColumn("_above", above).join(open_nodes.withColumnRenamed("node", "_above"), "_above", "left_semi") if level else both
        open_nodes = found.select("node")
    return open_nodes


def differences(before: DataFrame, after: DataFrame, leaves: DataFrame, digits: int = 4) -> DataFrame:
    """key and change ('added', 'removed', 'changed') of the ``digested`` rows in ``leaves``; only these rows are
    joined. Of keys that repeat, the sorted digests are compared."""
    def of(rows: DataFrame, name: str) -> DataFrame:
        inside = rows.withColumn("node", F.substring("path", 1, digits)).join(leaves, "node", "left_semi")
        return inside.groupBy("key").agg(joined("digest").alias(name))

    both = of(before, "a").join(of(after, "b"), "key", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(F.regexp_replace("key", "^=", "").alias("key"), change.alias("change"))
