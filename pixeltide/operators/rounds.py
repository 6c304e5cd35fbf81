"""Reliable checkpoints for operators that go round by round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that spark.checkpoint.dir names; one of our own only on a local master."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all machines share")
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def joined(links: DataFrame, by: str) -> DataFrame:
    """by, node, root: the least node that each linked node of links(by, a, b) reaches, group by group.

    Each round every node hands its least neighbour to the others, by turns to larger ones only and to all, until all edges of
    a group's part lead to its least node. Nodes without links aren't in the result.
    """
    edges = checkpoint(links.select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        n, nodes = edges.agg(F.count("*"), F.countDistinct(by, "a")).first()
        if n == nodes and edges.select(by, F.col("b").alias("a")).join(edges.select(by, "a"), [by, "a"], "left_semi").isEmpty():
            break  # each node has one edge, to a node without one
        both = edges.unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(by, "a").agg(F.min("b").alias("m")).select(by, "a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, [by, "a"]).select(by, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = up.groupBy(by, "a").agg(F.min("b").alias("m"))
        down = up.join(low, [by, "a"]).where("b <> m").select(by, F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(down.unionByName(low.select(by, "a", F.col("m").alias("b"))).distinct())
    roots = edges.select(by, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(by, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
