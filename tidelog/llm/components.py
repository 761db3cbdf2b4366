"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node hands the smallest node it knows to its larger (or, in a small star, its smaller) neighbours."""
    known = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = known.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = known.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; the root is the smallest node that links reach.

    Links may repeat and go either way; a link of a node to itself is ignored. Nothing is
    collected: each round is written, and rounds end when every link leads from a node to a root.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    while True:
        edges = cut(_star(_star(edges, True), False))
        # a node with two links, or a root that has one itself, needs another round
        pending = edges.select("a").unionByName(edges.select(F.col("b").alias("a")).distinct()).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if pending.isEmpty():
            break
    return nodes.join(edges.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
