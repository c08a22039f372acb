"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize, salt, salt_mask, salted


def with_least(edges: DataFrame) -> DataFrame:
    """`edges` (u, v) with m, the smallest neighbour of u; a node of any number of neighbours is dealt over parts by them."""
    dealt = edges.withColumn("part", salt(F.col("v")))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), salt_mask(F.col("part")).alias("mask"))
    return dealt.join(salted(least, "mask", "part"), ["u", "part"]).drop("part")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """`edges` has v < u: every u and its smaller neighbours are hung on the smallest of them."""
    return with_least(edges).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) of longs -> (node, component), component the smallest node reachable; nodes without edges are left out.

    The rounds number about the logarithm of the longest path; no round collects edges, and none holds the neighbours
    of a node together: each is a map-side combined minimum and a join with the node dealt over parts."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        after = materialize(small_star(large_star(now)), "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        before = state
