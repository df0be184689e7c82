"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.sources.shared import sorted_in


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node ties its larger (or its smaller) neighbours to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(sorted_in(least), "a")
    tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b")))
    return tied.where("a != b").distinct()


def components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, component): the smallest id reachable from each id of `edges` (a, b); ids without an edge are left out.
    Large-star and small-star rounds end when the edges are stars around smallest ids; every round is saved by `save`."""
    edges = save(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        edges = save(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
