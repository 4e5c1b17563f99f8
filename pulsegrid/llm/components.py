"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Each node tells its larger (or smaller) neighbours of the least node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    told = both.join(least, "a")
    if large:
        told = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        told = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return told.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges(a, b)``, longs."""
    edges, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        edges = cut(_step(_step(edges, True), False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
