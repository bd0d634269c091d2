"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stored


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, as (u, v) with u < v; loops and null ends dropped."""
    return (edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .filter(F.col("u") < F.col("v")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood instead."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written before the join, so that a hub's links can be split over tasks
    least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
    return _tidy(edges.join(least, "u").select(F.col("m").alias("u"), "v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = stored(edges.groupBy("v").agg(F.min("u").alias("m")), "small-star")
    tied = edges.join(least, "v").select("u", F.col("m").alias("v"))
    return _tidy(tied.union(least.select(F.col("v").alias("u"), F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a link table (u, v): the smallest node that links reach.

    Hubs are aggregated map-side and their links split; the number of rounds grows with the logarithm
    of the longest chain. Each round is a written table, so a lost executor costs one round at most.
    """
    current = stored(_tidy(edges), "links")
    while True:
        new = stored(_small_star(stored(_large_star(current), "stars")), "links")
        # a forest of stars: no node with two centres, no centre that has a centre
        twice = new.groupBy("v").count().filter("count > 1").select("v")
        chained = new.select(F.col("u").alias("v")).distinct().join(new.select("v"), "v", "left_semi")
        current = new
        if twice.unionByName(chained).isEmpty():
            break
    tied = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return tied.union(current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
