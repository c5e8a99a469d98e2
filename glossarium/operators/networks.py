"""Colexification: concepts that a doculect names by the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import doculect_pairs


def colexifications(df: DataFrame, entry: str = "form", family: str = "doculect") -> DataFrame:
    """doculect, family, form and two concepts (a < b) that it names."""
    keys = [k for k in dict.fromkeys(["doculect", family, entry])]
    one = df.groupBy(*keys, "concept").agg(F.min("id").alias("id"))
    a, b = one.withColumnRenamed("concept", "a").drop("id"), one.withColumnRenamed("concept", "b").drop("id")
    return a.join(b, keys).where("a < b")


def edges(df: DataFrame, entry: str = "form", family: str = "doculect") -> DataFrame:
    """Pairs of concepts with the forms, doculects and families that colexify them."""
    found = colexifications(df, entry, family)
    return found.groupBy("a", "b").agg(
        F.count("*").alias("word_weight"), F.count_distinct("doculect").alias("doculect_weight"), F.count_distinct(family).alias("family_weight")
    )


def bipartite_edges(df: DataFrame, entry: str = "form") -> DataFrame:
    """form, concept and the number of doculects, for forms with more than one concept in a doculect."""
    found = colexifications(df, entry)
    ends = found.select("doculect", F.col(entry).alias("form"), F.explode(F.array("a", "b")).alias("concept")).distinct()
    return ends.groupBy("form", "concept").agg(F.count("*").alias("doculects"))


def nodes(df: DataFrame, family: str = "doculect") -> DataFrame:
    """Words, doculects and families of each concept."""
    return df.groupBy("concept").agg(F.count("*").alias("words"), F.count_distinct("doculect").alias("doculects"), F.count_distinct(family).alias("families"))


def degrees(df: DataFrame, entry: str = "form", weight: str = "word_weight") -> DataFrame:
    """Degree and weighted degree of each concept in the network."""
    e = edges(df, entry)
    ends = e.select(F.explode(F.array("a", "b")).alias("concept"), weight)
    return ends.groupBy("concept").agg(F.count("*").alias("degree"), F.sum(weight).alias("weighted_degree"))


def distances(df: DataFrame, entry: str = "form") -> DataFrame:
    """1 - shared / all pairs of concepts that two doculects colexify; null if neither colexifies any."""
    sets = colexifications(df, entry).select("doculect", F.col("a").alias("c1"), F.col("b").alias("c2")).distinct()
    sizes = sets.groupBy("doculect").agg(F.count("*").alias("n"))
    a, b = sets.withColumnRenamed("doculect", "a"), sets.withColumnRenamed("doculect", "b")
    common = a.join(b, ["c1", "c2"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    named = lambda x: sizes.select(F.col("doculect").alias(x), F.col("n").alias(f"n_{x}"))
    joined = doculect_pairs(df).join(named("a"), "a", "left").join(named("b"), "b", "left").join(common, ["a", "b"], "left").na.fill(0)
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return joined.select("a", "b", F.when(union > 0, 1 - F.col("common") / union).alias("distance"))
