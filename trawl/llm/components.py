"""Connected components by alternating large and small stars, on tables that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trawl.llm.shared import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Every node's larger (or smaller) neighbours are tied to its least neighbour instead of to it."""
    if large:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Per node with an edge that isn't the least of its component: u, c, the least."""
    now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    seen = None
    while True:
        now = materialize(_stars(materialize(_stars(now, True)), False))
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == seen:
            return now.select("u", F.col("v").alias("c"))
        seen = mark
