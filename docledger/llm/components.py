"""Connected components by alternating stars, all joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (u, v) reach; for linked nodes only.

    Every round hangs nodes under their smallest neighbour, first the larger ones
    (large star), then the smaller ones (small star). Each round is written, which
    cuts the lineage and survives lost executors; rounds grow with the logarithm of
    the component size. Null nodes and links of a node to itself are ignored.
    """
    edges = persisted(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = persisted(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
