"""Connected components by alternating stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Large star: each node links its larger neighbours to the smallest node
    next to it. Small star: each node links its smaller neighbours and itself
    to the smallest. Both only take minima by key, which Spark sums up before
    the shuffle, so a hub needs no list of its neighbours; the join that
    follows is one that adaptive execution splits. Each round is a table in
    the shared folder. Rounds grow with the logarithm of a component's width.
    Self links, repeated links and nulls do nothing; no links give no rows.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = shared.Tables(spark)
    now, sums = own.written(now, "links"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, own.written(small.where("u <> v").distinct(), "links")
        own.drop(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == sums:
            break
        sums = found
    least = now.groupBy("u").agg(F.min("v").alias("v"))
    return least.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least.select(F.col("v"), F.col("v")).distinct())
