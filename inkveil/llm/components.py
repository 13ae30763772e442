"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the least node that links reach.

    Alternates large-star and small-star steps, each a grouped minimum and a join back; a node with very many links only
    meets partial minima and a join that Spark can split. Every step is written to the shared folder."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.of).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(least, large.u == least.of)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
