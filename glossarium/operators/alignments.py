"""Multiple alignments of cognate sets, their consensus, confidence and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import multiple
from .graphs import kept


def set_items(df: DataFrame, ref: str = "cogid", entry: str = "form") -> DataFrame:
    """block (the set), _entry and item (its segments joined by spaces) of every form of every set."""
    words = kept(df.select(F.col(ref).cast("string").alias("block"), F.col(entry).alias("_entry")).where("block is not null and _entry is not null").distinct())
    return words.join(multiple.spelled_forms(words, "_entry"), "_entry")


def align_sets(df: DataFrame, ref: str = "cogid", entry: str = "form", method: str = "progressive") -> DataFrame:
    """df with alignment (array of segments and '-'): every word aligned with the distinct forms of its set.

    Equal forms of a set are aligned once; sets are aligned side by side, level by level (see multiple).
    Words without a form or a set have a null alignment.
    """
    units = set_items(df, ref, entry)
    aligned = multiple.align_items(units.select("block", "item").distinct(), method)
    rows = units.join(aligned, ["block", "item"]).select(F.col("block").alias("_block"), "_entry", F.col("alignment").alias("_alignment"))
    named = df.join(rows, (F.col(ref).cast("string") == F.col("_block")) & (F.col(entry) == F.col("_entry")), "left")
    return named.select(*df.columns, F.col("_alignment").alias("alignment"))


def consensus(aligned: DataFrame, ref: str = "cogid", gap_scale: float = 1.0, gaps: bool = False) -> DataFrame:
    """The most frequent segment of each column of each set; ties go to the one that the word of the least id has."""
    cells = aligned.select(F.col(ref).alias("ref"), "id", F.posexplode("alignment").alias("pos", "x"))
    counts = cells.groupBy("ref", "pos", "x").agg((F.count("*") * F.when(F.col("x") == "-", gap_scale).otherwise(1.0)).alias("n"), F.min("id").alias("first"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("ref", "pos").orderBy(F.desc("n"), "first"))).where("r = 1")
    kept = best if gaps else best.where("x <> '-'")
    joined = kept.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return joined.select(F.col("ref").alias(ref), F.array_join(F.transform("c", lambda c: c["x"]), " ").alias("consensus"))


def correspondence_counts(aligned: DataFrame, ref: str = "cogid") -> DataFrame:
    """Segments of two doculects that stand in one column: a, b, x, y and in how many columns.

    Cells are counted by segment before the doculects meet, so a set with many
    words of a doculect is not squared.
    """
    cells = aligned.select(F.col(ref).alias("ref"), "doculect", F.posexplode("alignment").alias("pos", "x")).groupBy("ref", "pos", "doculect", "x").agg(F.count("*").alias("n"))
    a = cells.select("ref", "pos", F.col("doculect").alias("a"), "x", "n")
    b = cells.select("ref", "pos", F.col("doculect").alias("b"), F.col("x").alias("y"), F.col("n").alias("m"))
    return a.join(b, ["ref", "pos"]).where("a < b").groupBy("a", "b", "x", "y").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def confidence(aligned: DataFrame, scores: DataFrame, ref: str = "cogid") -> DataFrame:
    """ref, id, pos and the mean score of a cell's segment with those of other doculects in its column; scores: a, b, x, y, score."""
    both = scores.select("a", "b", "x", "y", "score").union(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"), "score"))
    cells = aligned.select(F.col(ref).alias("ref"), "id", F.col("doculect").alias("a"), F.posexplode("alignment").alias("pos", "x"))
    others = cells.groupBy("ref", "pos", F.col("a").alias("b"), F.col("x").alias("y")).agg(F.count("*").alias("n"))
    kinds = cells.select("ref", "pos", "a", "x").distinct().join(others, ["ref", "pos"]).where("a <> b").join(both, ["a", "b", "x", "y"])
    means = kinds.groupBy("ref", "pos", "a", "x").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("confidence"))
    return cells.join(means, ["ref", "pos", "a", "x"], "left").select(F.col("ref").alias(ref), "id", "pos", "confidence")


def identity_of_sets(aligned: DataFrame, ref: str = "cogid") -> DataFrame:
    """Mean share of equal cells over the pairs of distinct rows of each set (1 for a set of one)."""
    rows = aligned.select(F.col(ref).alias("ref"), "alignment").distinct()
    cells = rows.withColumn("row", F.xxhash64("alignment")).select("ref", "row", F.posexplode("alignment").alias("pos", "x"))
    per = cells.groupBy("ref", "pos", "x").agg(F.count("*").alias("n")).where("x <> '-'").groupBy("ref").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    sizes = rows.groupBy("ref").agg(F.count("*").alias("k"), F.max(F.size("alignment")).alias("width"))
    pairs = F.col("k") * (F.col("k") - 1) / 2 * F.col("width")
    return sizes.join(per, "ref", "left").select(F.col("ref").alias(ref), F.when(pairs == 0, 1.0).otherwise(F.coalesce("same", F.lit(0.0)) / pairs).alias("identity"))


def compare_alignments(gold: DataFrame, test: DataFrame, ref: str = "cogid") -> DataFrame:
    """For each set: share of gold's columns and of test's that the other has too (recall, precision), and of equal rows.

    A column is the places of the segments in it, so alignments of different
    width can be held against each other.
    """

    def columns(df: DataFrame, name: str) -> DataFrame:
        place = F.transform("alignment", lambda x, i: F.when(x == "-", -1).otherwise(F.size(F.filter(F.slice("alignment", 1, i + 1), lambda y: y != "-"))))
        cells = df.select(F.col(ref).alias("ref"), "id", F.posexplode(place).alias("pos", "place"))
        return cells.groupBy("ref", "pos").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("id", "place")))).alias("column")).withColumn(name, F.lit(1))

    joined = columns(gold, "g").drop("pos").join(columns(test, "t").drop("pos"), ["ref", "column"], "full_outer")
    shared = F.sum(F.when(F.col("g").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0))
    scores = joined.groupBy("ref").agg((shared / F.sum("g")).alias("recall"), (shared / F.sum("t")).alias("precision"))
    rows = gold.select(F.col(ref).alias("ref"), "id", F.col("alignment").alias("x")).join(test.select("id", F.col("alignment").alias("y")), "id")
    return scores.join(rows.groupBy("ref").agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("rows")), "ref").withColumnRenamed("ref", ref)


def _weighted_pairs() -> Column:
    """Sum of w * v over the pairs of rows of a group, from sums over its rows."""
    return (F.pow(F.sum("w"), F.lit(2)) - F.sum(F.col("w") * F.col("w"))) / 2


def column_scores(gold: DataFrame, test: DataFrame, ref: str = "cogid") -> DataFrame:
    """For each set: gold's columns that test has too, over test's (precision), gold's (recall), their mean number (mean), and the fscore.

    A column is the segments and gaps in it, wherever it stands, so that equal
    columns of gold count each. Columns are told apart by a sum of hashes of
    their cells (128 bits): a set's words are never gathered.
    """

    def columns(df: DataFrame) -> DataFrame:
        cells = df.select(F.col(ref).alias("ref"), "id", F.posexplode("alignment").alias("pos", "x"))
        marks = [F.sum(F.xxhash64(F.lit(k), "id", "x").cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)]
        return cells.groupBy("ref", "pos").agg(*marks).groupBy("ref", "h0", "h1").agg(F.count("*").alias("n"))

    both = columns(gold).withColumnRenamed("n", "g").join(columns(test).withColumnRenamed("n", "t"), ["ref", "h0", "h1"], "full_outer")
    sums = both.groupBy("ref").agg(F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("g"))), F.lit(0)).alias("c"), F.sum("g").alias("g"), F.sum("t").alias("t"))
    p, r = F.col("c") / F.col("t"), F.col("c") / F.col("g")
    scores = sums.select("ref", p.alias("precision"), r.alias("recall"), (2 * F.col("c") / (F.col("g") + F.col("t"))).alias("mean"))
    fscore = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return scores.withColumn("fscore", fscore).withColumnRenamed("ref", ref)


def row_scores(gold: DataFrame, test: DataFrame, ref: str = "cogid") -> DataFrame:
    """For each set the share of its words that are aligned alike."""
    rows = gold.select(F.col(ref), "id", F.col("alignment").alias("x")).join(test.select("id", F.col("alignment").alias("y")), "id")
    return rows.groupBy(ref).agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("rows"))


def residue_scores(gold: DataFrame, test: DataFrame, ref: str = "cogid") -> DataFrame:
    """For each set, over pairs of segments in one column: those in both alignments over gold's (sp_recall), test's (sp_precision), the mean and all (jaccard).

    The first word (by id) of each sequence stands for it, with weight 1 / the
    number of its words. Pairs are counted from cells: two words meet at the
    same places in both if they share gold's and test's column, so the pairs of
    a set are never made. Null where no pair is.
    """
    place = F.transform("alignment", lambda x, i: F.struct(i.alias("pos"), F.when(x != "-", F.size(F.filter(F.slice("alignment", 1, i + 1), lambda y: y != "-"))).alias("place")))
    word = F.array_join(F.filter("alignment", lambda x: x != "-"), "")

    firsts = gold.select(F.col(ref).alias("ref"), "id", word.alias("word")).groupBy("ref", "word").agg(F.min("id").alias("id"), (1 / F.count("*")).alias("w")).select("ref", "id", "w")
    cells = lambda df, name: df.select("id", F.explode(place).alias("c")).where("c.place is not null").select("id", F.col("c.place").alias("place"), F.col("c.pos").alias(name))
    both = firsts.join(cells(gold, "g"), "id").join(cells(test, "t"), ["id", "place"])
    parts = {"rrp": ["ref", "g"], "trp": ["ref", "t"], "crp": ["ref", "g", "t"]}
    found = None
    for name, keys in parts.items():
        part = both.groupBy(*keys).agg(_weighted_pairs().alias("v")).groupBy("ref").agg(F.sum("v").alias(name))
        found = part if found is None else found.join(part, "ref")
    some = lambda whole: F.when(whole > 0, F.col("crp") / whole)
    r, t, c = F.col("rrp"), F.col("trp"), F.col("crp")
    return found.select(F.col("ref").alias(ref), some(r).alias("sp_recall"), some(t).alias("sp_precision"), some((r + t) / 2).alias("sp_mean"), some(r + t - c).alias("jaccard"))


def _columns_of(a: Column, b: Column) -> Column:
    """(place of a's segment, place of b's) for each column of two aligned arrays, 0 for a gap."""
    place = lambda s, x, i: F.when(x == "-", 0).otherwise(F.size(F.filter(F.slice(s, 1, i + 1), lambda y: y != "-")))
    return F.arrays_zip(F.transform(a, lambda x, i: place(a, x, i)).alias("x"), F.transform(b, lambda y, i: place(b, y, i)).alias("y"))


def pairwise_scores(gold: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of pairwise alignments (arrays a and b, one row for each keys) against gold ones, over all pairs (one row).

    half_rows and rows: sequences, and whole pairs, that are aligned alike;
    precision, recall and fscore: columns with gaps; sp and jaccard: columns
    without gaps that both have over gold's, and over all.
    """
    joined = gold.select(*keys, F.col("a").alias("ga"), F.col("b").alias("gb")).join(test.select(*keys, F.col("a").alias("ta"), F.col("b").alias("tb")), keys)
    g, t = _columns_of(F.col("ga"), F.col("gb")), _columns_of(F.col("ta"), F.col("tb"))
    full = lambda c: F.filter(c, lambda p: (p["x"] != 0) & (p["y"] != 0))
    rows = joined.select(((F.col("ga") == F.col("ta")).cast("int")).alias("ra"), ((F.col("gb") == F.col("tb")).cast("int")).alias("rb"), g.alias("g"), t.alias("t"))
    both = F.filter("t", lambda p: F.array_contains("g", p))
    counted = rows.select("ra", "rb", F.size("g").alias("grrp"), F.size("t").alias("gtrp"), F.size(both).alias("gcrp"), F.size(full(F.col("g"))).alias("rrp"), F.size(full(F.col("t"))).alias("trp"), F.size(full(both)).alias("crp"))
    sums = counted.agg(F.avg((F.col("ra") + F.col("rb")) / 2).alias("half_rows"), F.avg(F.col("ra") * F.col("rb")).alias("rows"), *[F.sum(c).alias(c) for c in ("grrp", "gtrp", "gcrp", "rrp", "trp", "crp")])
    scores = sums.select("half_rows", "rows", (F.col("gcrp") / F.col("gtrp")).alias("precision"), (F.col("gcrp") / F.col("grrp")).alias("recall"), F.when(F.col("rrp") > 0, F.col("crp") / F.col("rrp")).alias("sp"), F.when(F.col("rrp") + F.col("trp") > 0, F.col("crp") / (F.col("rrp") + F.col("trp") - F.col("crp"))).alias("jaccard"))
    return scores.withColumn("fscore", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def pairwise_differences(gold: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Both alignments of the pairs that are not aligned alike: keys, gold_a, gold_b, a, b."""
    joined = gold.select(*keys, F.col("a").alias("gold_a"), F.col("b").alias("gold_b")).join(test.select(*keys, "a", "b"), keys)
    return joined.where((F.col("gold_a") != F.col("a")) | (F.col("gold_b") != F.col("b")))


def drop_gap_columns(aligned: DataFrame, ref: str = "cogid") -> DataFrame:
    """Alignments without the columns in which every word of the set has a gap."""
    cells = aligned.select(F.col(ref).alias("ref"), "id", F.posexplode("alignment").alias("pos", "x"))
    solid = cells.groupBy("ref", "pos").agg(F.max((F.col("x") != "-").cast("int")).alias("s")).where("s = 1").drop("s")
    rows = cells.join(solid, ["ref", "pos"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return aligned.drop("alignment").join(rows.select("id", F.transform("c", lambda c: c["x"]).alias("alignment")), "id")
