"""Connected components of a link table by alternating large and small stars, all in Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import store


def components(links: DataFrame) -> DataFrame:
    """Columns node and component (the smallest node reachable) for all ends of links (a, b); single nodes without links are not in it."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = store.written(edges, "edges"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti").withColumn("component", F.col("node")))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        spent, edges = edges, store.written(small.where("u <> v").distinct(), "edges")
        store.forget(spent)
