"""Connected components by alternating large-star and small-star rounds, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A written table: node, component for every node of ``links`` (columns a, b: long); component is the smallest node reachable.

    No round gathers a node's neighbours in one place: they are met by a grouped minimum and a join.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = written(edges, "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        old, edges = edges, written(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(old)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(new):
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = written(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            discard(edges)
            return out
        mark = tuple(new)
