"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node that a link (a, b) names.

    Alternates the large-star and small-star steps, which keep the number of links and need a number of
    rounds that grows with its logarithm; each round is cut off in the shared folder.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _print(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        last, edges = edges, stash(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "links")
        unstash(last)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _print(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two combined hashes."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.bit_xor(F.xxhash64(mixed))).first())
