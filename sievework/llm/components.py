"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join on the node, so a hub with
a large share of all links is split like any skewed join. Every step is written to the shared
folder; no link or component goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.session import freeze


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (large) or smaller-or-equal (small) neighbour of a node to the smallest one."""
    if large:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        out = joined.select(F.explode(pairs).alias("e")).select("e.*").filter("a <> b")
    return out.distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node that has a link; the root is the smallest node it can reach.

    `edges` has columns a and b of one type that can be ordered. Nulls, loops and repeated links do
    not matter; no links give no rows.
    """
    stars = freeze(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while (now := _mark(stars)) != before:
        before = now
        if not now[0]:
            break
        stars = freeze(_star(_star(stars, large=True), large=False))
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
