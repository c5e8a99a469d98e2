"""Evaluation of cognate sets and of reconstructed forms against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import edit_distance


def _first_words(df: DataFrame, ref: str) -> DataFrame:
    """The first word of each doculect in each set of ref: those that evaluation counts."""
    return df.groupBy(F.col(ref).alias("ref"), "doculect").agg(F.min("id").alias("id")).select("ref", "id")


def _bcubed_side(df: DataFrame, one: str, other: str) -> DataFrame:
    """Sum and number of the scores of one against other: for each word, the share of its set that the other way puts with it; 1 for a set of one."""
    words = _first_words(df, one).join(df.select("id", F.col(other).alias("other")), "id")
    sizes = words.groupBy("ref").agg(F.count("*").alias("size"))
    together = words.groupBy("ref", "other").agg(F.count("*").alias("n")).join(sizes, "ref")
    # the n words of a cell have the score n / size each
    return together.agg(F.sum(F.col("n") * F.col("n") / F.col("size")).alias("sum"), F.sum("n").alias("count"))


def bcubes(df: DataFrame, gold: str = "cogid", test: str = "testid") -> DataFrame:
    """B-cubed precision, recall and F (one row)."""
    recall = _bcubed_side(df, gold, test).select((F.col("sum") / F.col("count")).alias("recall"))
    precision = _bcubed_side(df, test, gold).select((F.col("sum") / F.col("count")).alias("precision"))
    both = precision.join(F.broadcast(recall))
    return both.select("precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("fscore"))


def bcubes_by_concept(df: DataFrame, gold: str = "cogid", test: str = "testid") -> DataFrame:
    """B-cubed precision, recall and F of each concept, all its words counted."""
    cell = F.count("*").over(Window.partitionBy("concept", gold, test))
    scored = df.select(
        "concept",
        (cell / F.count("*").over(Window.partitionBy("concept", gold))).alias("r"),
        (cell / F.count("*").over(Window.partitionBy("concept", test))).alias("p"),
    )
    per = scored.groupBy("concept").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"))
    return per.withColumn("fscore", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def partial_bcubes(df: DataFrame, gold: str, test: str) -> DataFrame:
    """B-cubed scores over list-valued ids: every morpheme (word and place) counts (one row)."""
    rows = df.select("id", F.posexplode(F.arrays_zip(F.col(gold).alias("g"), F.col(test).alias("t"))).alias("pos", "x")).select("x.g", "x.t")
    cells = rows.groupBy("g", "t").agg(F.count("*").alias("n"))
    side = lambda k, name: cells.withColumn("size", F.sum("n").over(Window.partitionBy(k))).agg((F.sum(F.col("n") * F.col("n") / F.col("size")) / F.sum("n")).alias(name))
    both = side("t", "precision").join(F.broadcast(side("g", "recall")))
    return both.withColumn("fscore", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def pair_scores(df: DataFrame, gold: str = "cogid", test: str = "testid") -> DataFrame:
    """Precision, recall and F of the pairs of words that are put together (one row).

    Pairs are counted from the sizes of sets and of their meetings, n over 2,
    and are never made. The first words of gold and test sets differ, so a
    meeting counts the words that are first in both.
    """
    g, t = _first_words(df, gold), _first_words(df, test)
    pairs = lambda x: x.groupBy("ref").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    meet = g.withColumnRenamed("ref", "gold").join(t.withColumnRenamed("ref", "test"), "id").groupBy("gold", "test").agg(F.count("*").alias("n"))
    both = meet.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"))
    row = both.join(F.broadcast(pairs(g).withColumnRenamed("pairs", "gold"))).join(F.broadcast(pairs(t).withColumnRenamed("pairs", "test")))
    row = row.select((F.col("both") / F.col("test")).alias("precision"), (F.col("both") / F.col("gold")).alias("recall"))
    return row.withColumn("fscore", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def average_precision(df: DataFrame, score: str, relevant: str, order: str = "id", groups: list[str] | None = None) -> DataFrame:
    """Average precision of rows in order of score (least first, ties by order) for each group; 0 if none is relevant."""
    keys = groups or []
    w = Window.partitionBy(*keys).orderBy(score, order)
    ranked = df.select(*keys, F.col(relevant).cast("int").alias("r"), F.row_number().over(w).alias("rank"), F.sum(F.col(relevant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("found"))
    total = F.sum("r")
    return ranked.groupBy(*keys).agg(F.when(total == 0, 0.0).otherwise(F.sum(F.col("r") * F.col("found") / F.col("rank")) / total).alias("average_precision"))


def extreme_cognates(df: DataFrame, bias: str = "lumper", ref: str = "extremeid") -> DataFrame:
    """df with one set for each concept (lumper) or for each word (splitter)."""
    if bias == "splitter":
        return df.withColumn(ref, F.col("id"))
    # concepts are a dimension: one row each in the window
    numbered = df.select("concept").distinct().withColumn(ref, F.row_number().over(Window.orderBy("concept")).cast("long"))
    return df.join(F.broadcast(numbered), "concept").select(*df.columns, ref)


def random_cognates(df: DataFrame, seed: int, ref: str = "randomid") -> DataFrame:
    """df with a random set for each word, within its concept; as many sets at most as the concept has words."""
    n = F.count("*").over(Window.partitionBy("concept"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), n)
    return df.withColumn(ref, F.concat_ws(":", "concept", draw.cast("string")))


def mean_edit_distance(df: DataFrame, gold: str, test: str, ref: str = "cogid") -> DataFrame:
    """Mean distance of test from gold (segment arrays) over the sets of ref, plain and by the longer (one row); a set's first word counts."""
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(ref).orderBy("id"))).where("__r = 1")
    d = edit_distance(F.col(gold), F.col(test))
    longer = F.greatest(F.size(gold), F.size(test))
    return first.agg(F.avg(d).alias("distance"), F.avg(F.when(longer == 0, 0.0).otherwise(d / longer)).alias("normalized"))


def cluster_report(df: DataFrame, gold: str = "cogid", test: str = "testid") -> DataFrame:
    """Concepts whose sets differ: words, gold sets, test sets, and B-cubed scores."""
    sizes = df.groupBy("concept").agg(F.count("*").alias("words"), F.count_distinct(gold).alias("gold_sets"), F.count_distinct(test).alias("test_sets"))
    return sizes.join(bcubes_by_concept(df, gold, test), "concept").where("fscore < 1")
