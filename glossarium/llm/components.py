"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) for every node that is in an edge to another.

    edges: two bigint columns a and b, in any order and with repeats; edges with
    a null or from a node to itself are not used. Every step moves edges towards
    the least neighbour, each is checkpointed in the shared folder, and the
    steps end when the edges no longer change, after a number of rounds that is
    logarithmic in the longest path. No node's neighbours are gathered: a step
    needs only the least of them.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = cut(edges.where(F.col(a) != F.col(b)).select(u, v).distinct())
    before, now = None, _digest(stars)
    while before != now and now[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = cut(small.distinct())
        before, now = now, _digest(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
