"""Connected components of an edge table by alternating large-star and
small-star steps. Every step is one aggregate and one join; its result is
written to the shared checkpoint folder, so a lost executor costs one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` (u, v): v is a neighbour of u (small: a smaller one)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    met = pairs.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("a"), F.col("low").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs, any order, repeats allowed; returns (node,
    component) with the smallest node of the component, for nodes with an edge."""
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stage(_star(both, small=False), "large")
        now = stage(_star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), small=True),
                    "small")
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
