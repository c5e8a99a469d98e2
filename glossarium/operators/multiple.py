"""Multiple alignments of sets of forms, level by level along a guide tree, and libraries of consistent residues.

A set is never gathered: its forms are rows of a table, with the column of every
segment in the alignment that they are part of so far. In each round all pairs of
clusters that are each other's nearest (as in average linkage) are joined, over all
sets at once. What a task sees of the two is a profile: how many segments each column
has, and what every two columns score; its size depends on the alignments' lengths,
not on the number of forms. The way through a profile then moves the columns of
the forms by a join.

A form that has no segments takes no part and gets gaps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import Sequences, align_all
from .graphs import kept
from .lexstat import segmented, spread
from .linkage import merge_rounds

GAP = "-"
#: Scores of equal and of unlike segments, cost of a gap, of its going on (a share of that), and what a gap counts in a column's mean.
MATCH, MISMATCH, GOP, SCALE, GAP_WEIGHT = 1.0, -1.0, -1.0, 0.5, 0.5
#: Kinds of pairwise alignments that a library is made of.
LIBRARY_MODES = ("global", "local")
#: Pairs aligned at once.
BATCH = 1024


def segments(item: Column) -> Column:
    """The segments of an item, which is segments joined by spaces."""
    return F.filter(F.split(item, " "), lambda x: x != "")


def spelled_forms(forms: DataFrame, entry: str) -> DataFrame:
    """entry and item (its segments joined by spaces) of every distinct form; null forms go."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield rows.assign(item=[" ".join(segmented(f)) for f in rows[entry]])

    return forms.where(F.col(entry).isNotNull()).select(entry).distinct().mapInPandas(run, f"`{entry}` string, item string")


def item_pairs(units: DataFrame) -> DataFrame:
    """block, a, b: every two items of a block (a < b); units: block, item, each once."""
    filled = units.where("item <> ''")
    return filled.toDF("block", "a").join(filled.toDF("block", "b"), "block").where("a < b")


def _aligned_batches(rows: pd.DataFrame, modes: tuple) -> Iterator[tuple]:
    """Rows' slice, both Sequences and, for each mode, scores and columns of their alignments."""
    names = sorted({*rows.a, *rows.b})
    split = [n.split(" ") for n in names]
    number = {x: k for k, x in enumerate(sorted({x for own in split for x in own}))}
    known, at = Sequences.of([[number[x] for x in own] for own in split]), {n: k for k, n in enumerate(names)}
    first, second = rows.a.map(at).to_numpy(np.int64), rows.b.map(at).to_numpy(np.int64)
    for k in range(0, len(rows), BATCH):
        own = slice(k, k + BATCH)
        x, y = known.take(first[own]), known.take(second[own])
        scores = np.where(x.codes[:, :, None] == y.codes[:, None, :], MATCH, MISMATCH)
        yield own, x, y, [align_all(scores, x.lengths, y.lengths, GOP * x.weights, GOP * y.weights, mode, SCALE) for mode in modes]


def pair_distances(pairs: DataFrame) -> DataFrame:
    """a, b and distance (1 - score / the mean of both own scores) of every two distinct items."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for own, x, y, [(score, _)] in _aligned_batches(rows, ("global",)):
                yield rows.iloc[own].assign(distance=1 - 2 * score / (MATCH * (x.lengths + y.lengths)))

    return spread(pairs.select("a", "b")).mapInPandas(run, "a string, b string, distance double")


def pair_links(pairs: DataFrame, modes: tuple = LIBRARY_MODES) -> DataFrame:
    """a, i, b, j and weight: the places that stand together in alignments of two distinct items; the weight is the share of equal columns, summed over the modes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for own, x, y, found in _aligned_batches(rows, modes):
                a, b = rows.a.to_numpy()[own], rows.b.to_numpy()[own]
                for _, columns in found:
                    i, j = columns()
                    row, step = np.nonzero((i >= 0) & (j >= 0))
                    i, j, length = i[row, step], j[row, step], (i > -2).sum(axis=1)
                    equal = np.bincount(row[x.codes[row, i] == y.codes[row, j]], minlength=len(a))
                    weight = equal / np.maximum(length, 1)
                    yield pd.DataFrame({"a": a[row], "i": i, "b": b[row], "j": j, "weight": weight[row]})

    links = spread(pairs.select("a", "b")).mapInPandas(run, "a string, i int, b string, j int, weight double")
    return links.groupBy("a", "i", "b", "j").agg(F.sum("weight").alias("weight"))


def extended_library(primary: DataFrame) -> DataFrame:
    """Weights of pairs of places with those through a third item: the lesser of both steps' weights, summed over all places between.

    primary: block, a, i, b, j, weight (a < b), each pair of places once. The join is
    on the place between, which meets one or two places of each other item, so
    that a large block is dealt out over its places.
    """
    there = primary.select("block", "a", "i", "b", "j", "weight")
    both = kept(there.union(primary.select("block", "b", "j", "a", "i", "weight")))
    back = both.toDF("block", "b", "j", "c", "k", "further")
    through = both.join(back, ["block", "b", "j"]).where("a < c").select("block", "a", "i", F.col("c").alias("b"), F.col("k").alias("j"), F.least("weight", "further").alias("weight"))
    return there.union(through).groupBy("block", "a", "i", "b", "j").agg(F.sum("weight").alias("weight"))


def library_weights(units: DataFrame, modes: tuple = LIBRARY_MODES) -> DataFrame:
    """block, a, i, b, j and weight of the extended library of each block's items."""
    pairs = kept(item_pairs(units))
    return extended_library(pairs.join(pair_links(pairs, modes), ["a", "b"]).select("block", "a", "i", "b", "j", "weight"))


def align_items(units: DataFrame, method: str = "progressive") -> DataFrame:
    """block, item and alignment (segments and '-') of every item; units: block and item (segments joined by spaces), each once.

    progressive: columns score the mean of what their segments do, gaps counted
    by GAP_WEIGHT. library: the mean weight in the extended library, gaps cost
    nothing. The guide tree is that of average linkage over pair_distances.
    """
    if method not in ("progressive", "library"):
        raise ValueError(f"unknown method: {method}")
    pairs = kept(item_pairs(units))
    weights = None
    if method == "library":
        one_way = kept(extended_library(pairs.join(pair_links(pairs), ["a", "b"]).select("block", "a", "i", "b", "j", "weight")))
        weights = one_way.union(one_way.select("block", "b", "j", "a", "i", "weight")).toDF("block", "item", "place", "other", "other_place", "weight")
    size = F.size(segments(F.col("item")))
    numbers = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    start = units.select("block", "item", F.col("item").alias("root"), numbers.alias("places"), size.alias("width"), F.lit(1).cast("long").alias("size"))
    members = kept(start)
    for merges in merge_rounds(pairs.join(pair_distances(pairs), ["a", "b"]).select("block", "a", "b", "distance"), float("inf")):
        moved = members.join(_paths(_profiles(members, merges, weights)), ["block", "root"], "left")
        places = F.when(F.col("into").isNotNull(), F.transform("places", lambda p: F.get("columns", p))).otherwise(F.col("places"))
        sums = [F.coalesce(f"new_{c}", c).alias(c) for c in ("width", "size")]
        members = kept(moved.select("block", "item", F.coalesce("into", "root").alias("root"), places.alias("places"), *sums))
    whole = members.groupBy("block").agg(F.max("width").alias("width"))
    cells = F.map_from_arrays("places", segments(F.col("item")))
    row = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.element_at(cells, k), F.lit(GAP)))
    none = F.array().cast("array<string>")
    return members.drop("width").join(whole, "block").select("block", "item", F.when(F.col("width") > 0, row).otherwise(none).alias("alignment"))


def _profiles(members: DataFrame, merges: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Every merge (block, a, b) with width, size and cells (side, column, segment, number) of both sides; with weights also p, q and v, the sum of those between two columns."""
    key = ["block", "a", "b"]
    end = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("root"))
    ends = merges.select(*key, F.explode(F.array(end(0, "a"), end(1, "b"))).alias("s")).select(*key, "s.side", "s.root")
    inside = members.join(ends, ["block", "root"]).withColumn("c", F.arrays_zip("places", segments(F.col("item")).alias("x")))
    cells = inside.select(*key, "side", "item", "width", "size", F.posexplode("c").alias("place", "c")).withColumns({"col": F.col("c.places"), "x": F.col("c.x")})
    counts = cells.groupBy(*key, "side", "col", "x").agg(F.count("*").alias("n"), F.first("width").alias("width"), F.first("size").alias("size"))
    of = lambda k, x: F.max(F.when(F.col("side") == k, F.col(x)))
    sizes = [of(k, x).alias(f"{x}_{c}") for k, c in enumerate("ab") for x in ("width", "size")]
    rows = counts.groupBy(*key).agg(*sizes, *[F.collect_list(c).alias(c) for c in ("side", "col", "x", "n")])
    if weights is None:
        return rows
    first = cells.where("side = 0").select(*key, "item", "place", F.col("col").alias("p"))
    second = cells.where("side = 1").select(*key, F.col("item").alias("other"), F.col("place").alias("other_place"), F.col("col").alias("q"))
    met = first.join(weights, ["block", "item", "place"]).join(second, [*key, "other", "other_place"])
    common = met.groupBy(*key, "p", "q").agg(F.sum("weight").alias("v"))
    return rows.join(common.groupBy(*key).agg(*[F.collect_list(c).alias(c) for c in "pqv"]), key, "left").withColumn("library", F.lit(True))


def _paths(profiles: DataFrame) -> DataFrame:
    """block, root, into, columns (the new place of each column), new_width and new_size of both sides of every merge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), BATCH):
                yield _ways(whole.iloc[k : k + BATCH].reset_index(drop=True))

    return profiles.mapInPandas(run, "block string, root string, into string, columns array<int>, new_width int, new_size long")


def _ways(rows: pd.DataFrame) -> pd.DataFrame:
    """The best ways through the pairs of profiles of some merges."""
    library = "library" in rows
    gop, scale, gap_weight = (0.0, 1.0, 0.0) if library else (GOP, SCALE, GAP_WEIGHT)
    lengths = [rows[f"width_{c}"].to_numpy(np.int64) for c in "ab"]
    sizes = [rows[f"size_{c}"].to_numpy(float) for c in "ab"]
    filled = [np.zeros((len(rows), int(n.max()))) for n in lengths]
    total = np.zeros((len(rows), filled[0].shape[1], filled[1].shape[1]))
    for r, row in enumerate(rows.itertuples()):
        names, codes = np.unique(np.asarray(row.x, object).astype(str), return_inverse=True)
        counts = np.zeros((2, max(lengths[0][r], lengths[1][r]), len(names)))
        counts[np.asarray(row.side), np.asarray(row.col), codes] = row.n
        for k in (0, 1):
            filled[k][r, : lengths[k][r]] = counts[k, : lengths[k][r]].sum(axis=1)
        if not library:
            equal = counts[0, : lengths[0][r]] @ counts[1, : lengths[1][r]].T
            every = np.outer(filled[0][r, : lengths[0][r]], filled[1][r, : lengths[1][r]])
            total[r, : lengths[0][r], : lengths[1][r]] = MATCH * equal + MISMATCH * (every - equal)
        elif row.p is not None:
            total[r, np.asarray(row.p), np.asarray(row.q)] = row.v
    both = filled[0][:, :, None] * filled[1][:, None, :]
    count = both + gap_weight * ((sizes[0] * sizes[1])[:, None, None] - both)
    costs = [gop * f / s[:, None] for f, s in zip(filled, sizes)]
    places = [p[:, ::-1] for p in align_all(total / np.where(count > 0, count, 1.0), *lengths, *costs, "global", scale)[1]()]
    out = []
    for r, row in enumerate(rows.itertuples()):
        used = places[0][r] > -2
        for root, own in ((row.a, places[0][r][used]), (row.b, places[1][r][used])):
            out.append((row.block, root, row.a, np.flatnonzero(own >= 0).tolist(), int(used.sum()), int(row.size_a + row.size_b)))
    return pd.DataFrame(out, columns=["block", "root", "into", "columns", "new_width", "new_size"])
