"""Connected components by alternating large-star and small-star steps, as joins and aggregates of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def _least(edges: DataFrame, name: str) -> tuple[DataFrame, str]:
    """u, v with the least neighbour m of u. The minima are written first, so that a node with many edges is a skewed join that Spark splits, and not one aggregate."""
    minima, path = common.written(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(minima, "u"), path


def large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each node u links its larger neighbours to the least node it knows (itself included)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, path = _least(both, "large-star")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct(), path


def small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each node u links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, path = _least(down, "small-star")
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct(), path


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges(u, v). Self links, repeated and reversed edges are fine; without edges there are no rows.

    Ends when a round changes no edge; each round is written to shared storage.
    """
    spark = edges.sparkSession
    now, path = common.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        large, large_path = large_star(now)
        large, mid_path = common.written(large, "edges")
        small, small_path = small_star(large)
        new, new_path = common.written(small, "edges")
        common.drop(spark, path, large_path, mid_path, small_path)
        now, path = new, new_path
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
