"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import kept


def _stars(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest of them and the node itself.

    The large star moves the larger neighbours, the small star the smaller ones. Edges are (u, v) with
    both directions present for the large star and u > v for the small one.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = edges.join(least, "u")
    if keep_larger:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("u > m").select("u", F.col("m").alias("v"))
    return moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """Nodes of the links (a, b) with ``label``, the smallest node they are connected to.

    Every round is written to the shared folder; rounds end when the table of stars no longer changes,
    after about the logarithm of the longest path. Only counts and a checksum reach the driver.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = kept(_stars(_stars(both, True), False), "stars")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
