"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step groups the links of a node, connects the node's neighbours to the smallest of them and drops doubles, until
every component is a star around its smallest id: each node has one edge, and none leads to a node with an edge of its
own. Nothing but one row of totals per round reaches the driver.

A hub with very many links is one key of the joins: the least neighbours are broadcast while the edges are at most SMALL,
and dealt out by SALTS beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import checkpoint

SMALL, SALTS = 1_000_000, 16


def spread(many: DataFrame, one: DataFrame, rows: int, small: int) -> DataFrame:
    """many(a, b) joined with one(a, m), which has a row for each a and at most `rows` rows."""
    if rows <= small:
        return many.join(F.broadcast(one), "a")
    salted = many.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"]).drop("salt")


def components(links: DataFrame, max_rounds: int = 200, small: int = SMALL) -> DataFrame:
    """node long, component_id long (the smallest id reachable) for each node of links(a, b) that is linked to another."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = checkpoint(edges)
    n = edges.count()
    for _ in range(max_rounds):
        if not n:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread(both.where("b > a"), least, 2 * n, small).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = spread(large, near, 2 * n, small).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpoint(moved.union(near.select("a", F.col("m").alias("b"))).distinct())
        n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if n == nodes and spread(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), edges.select("a", F.col("b").alias("m")), n, small).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component_id"))).groupBy("node").agg(F.min("component_id").alias("component_id"))
