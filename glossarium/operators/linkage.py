"""Flat clusters from tables of distances: linkage, density, Markov flow.

All take a table of pairs with the columns block, a, b and distance: two items
of a block (a concept, say), a < b, each pair once. Blocks are clustered side
by side, and a large block is never gathered in one task: the algorithms are rounds
of joins and aggregates over pairs, so that it is split like any other table.
item_clusters takes items with keys and the distances of keys instead, and
makes no table of the pairs of small blocks. The result has block, node and root, the least item of the node's
cluster, for items that share their cluster with others; items without a row are
clusters of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clusters import merged_in_rounds
from .graphs import components, kept

#: Decimals of a distance that count where two are compared: sums of doubles depend on their order.
DECIMALS = 9
#: Keys of one side of a tile of pairs.
TILE = 512
#: Items of a block that is clustered as one matrix (134 MB); larger ones go by rounds over their pairs.
MOST = 4096
#: Distances and items that one bin of blocks has at most, about, and keys up to which its distances are a matrix.
BIN_PAIRS, BIN_ITEMS, DENSE = 4_000_000, 500_000, 2048


def _named(found: DataFrame) -> DataFrame:
    return found.select("node.block", F.col("node.item").alias("node"), F.col("root.item").alias("root"))


def key_pairs(items: DataFrame, equal: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """key_a, key_b (key_a < key_b; with equal, <=) of all keys that share a block, each pair once (for each value of within).

    items: block and key (an integer), and the columns of within, on which the
    block decides. A block's keys are cut into parts of TILE, and every two
    parts are a row of two arrays, so that a large block is dealt out. Their
    pairs are made where they are also made distinct, in numbers: what is moved
    grows with the distinct pairs, not with those of all blocks.
    """
    place = F.row_number().over(Window.partitionBy(*within, "block").orderBy("key"))
    parts = items.select(*within, "block", "key").distinct().select("*", ((place - 1) / TILE).cast("int").alias("part"))
    parts = parts.groupBy(*within, "block", "part").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    a, b = (parts.select(*within, "block", F.col("part").alias(f"part_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    tiles = a.join(b, [*within, "block"]).where("part_a <= part_b")
    tiles = tiles.repartition(tasks(tiles.sparkSession), *within)
    one = tiles.select("*", F.posexplode("keys_a").alias("k", "key_a"))
    later = F.slice("keys_b", F.col("k") + (1 if equal else 2), F.size("keys_b"))
    pairs = one.select(*within, "key_a", F.explode(F.when(F.col("part_a") == F.col("part_b"), later).otherwise(F.col("keys_b"))).alias("key_b"))
    return pairs.distinct()


def tasks(spark: SparkSession) -> int:
    """As many tasks as the cluster runs at once, and as a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def linked(edges: DataFrame) -> DataFrame:
    """The connected items of each block: single linkage, if the edges are the pairs within the threshold."""
    item = lambda c: F.struct("block", F.col(c).alias("item"))
    return _named(components(edges.select(item("a").alias("a"), item("b").alias("b")), "a", "b"))


def tie_key(a: str, b: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string")).cast("binary"))


def linkage_clusters(pairs: DataFrame, threshold: float, linkage: str = "average") -> DataFrame:
    """Clusters by single, average or complete linkage, cut where the nearest two are further apart than threshold.

    pairs: all pairs of the items of a block; one without a distance (null) keeps
    its two clusters apart for ever. Clusters only merge if some pair of theirs is within the
    threshold, so the pairs of different components under it go first. Then all
    pairs of clusters that are each other's nearest merge in one round: as no
    merge brings a cluster nearer to a third one, the result is that of merging
    the nearest pair of all, again and again. Ties go by tie_key of the
    clusters' least items: an order as good as random, by which a part of all
    clusters merges in each round even if all distances are equal.
    """
    if linkage not in ("single", "average", "complete"):
        raise ValueError(f"unknown linkage: {linkage}")
    pairs = kept(pairs)
    whole = linked(pairs.where(F.round("distance", DECIMALS) <= threshold))
    if linkage == "single":
        return whole
    whole = kept(whole)
    of = lambda c: whole.select("block", F.col("node").alias(c), F.col("root").alias(f"in_{c}"))
    inner = pairs.join(of("a"), ["block", "a"]).join(of("b"), ["block", "b"]).where("in_a = in_b")
    found = whole.select("block", "node", F.col("node").alias("root"))
    for new in merge_rounds(inner, threshold, linkage):
        found = found.join(new.select("block", F.col("b").alias("root"), "a"), ["block", "root"], "left").select("block", "node", F.coalesce("a", "root").alias("root"))
    return found


def merge_rounds(pairs: DataFrame, threshold: float, linkage: str = "average") -> Iterator[DataFrame]:
    """The merges (block, a, b: cluster b goes into a) of each round, until no two clusters are within threshold."""
    live = kept(pairs.select("block", "a", "b", F.col("distance").alias("total"), F.lit(1).cast("long").alias("n"), "distance"))
    while True:
        order = F.struct(F.round("distance", DECIMALS).alias("d"), tie_key("a", "b").alias("key"), "a", "b")
        near = live.select("block", order.alias("p")).where(F.col("p.d") <= threshold)
        nearest = near.select("block", F.explode(F.array("p.a", "p.b")).alias("node"), "p").groupBy("block", "node").agg(F.min("p").alias("p"))
        mutual = nearest.groupBy("block", "p").agg(F.count("*").alias("n")).where("n = 2").select("block", "p.a", "p.b")
        new = kept(mutual)
        if new.isEmpty():
            break
        yield new
        live = kept(_merged(live, new, linkage))


def _merged(live: DataFrame, merges: DataFrame, linkage: str) -> DataFrame:
    """Pairs of clusters after the merges of b into a."""
    into = lambda c: merges.select("block", F.col("b").alias(c), F.col("a").alias(f"to_{c}"))
    moved = live.join(into("a"), ["block", "a"], "left").join(into("b"), ["block", "b"], "left")
    moved = moved.select("block", F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "total", "n", "distance").where("x <> y")
    # a null among the distances stays: sum and max would pass over it
    apart = F.max(F.col("distance").isNull())
    distance = F.sum("total") / F.sum("n") if linkage == "average" else F.max("distance")
    return moved.groupBy("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.when(~apart, distance).alias("distance")
    )


def density_clusters(pairs: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """DBSCAN (Ester et al., 1996): items with least items within threshold, themselves included, are cores; connected cores are a cluster.

    Another item goes to the cluster of its least core within threshold; items
    without one are noise, each a cluster of its own. A cluster's root is its
    least core.
    """
    near = kept(pairs.where(F.col("distance") <= threshold).select("block", "a", "b"))
    both = near.union(near.select("block", F.col("b").alias("a"), F.col("a").alias("b")))
    cores = kept(both.groupBy("block", F.col("a").alias("core")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("block", "core"))
    of = lambda c: cores.withColumnRenamed("core", c)
    between = near.join(of("a"), ["block", "a"], "left_semi").join(of("b"), ["block", "b"], "left_semi")
    joined = linked(between)
    roots = cores.select("block", F.col("core").alias("node")).join(joined, ["block", "node"], "left").select("block", "node", F.coalesce("root", "node").alias("root"))
    border = both.join(of("a"), ["block", "a"], "left_anti").join(of("b"), ["block", "b"], "left_semi").groupBy("block", "a").agg(F.min("b").alias("node"))
    return roots.union(border.join(roots, ["block", "node"]).select("block", "a", "root"))


def flow_weight(distance: Column) -> Column:
    """Weight of an edge in Markov clustering: -log2 of the square of 1 - distance, at most that of 1 - 1e-6."""
    return -F.log2(F.greatest(1 - distance, F.lit(1e-6)) ** 2)


def flow_clusters(pairs: DataFrame, threshold: float, inflation: float = 2.0, prune: float = 1e-5, rounds: int = 100) -> DataFrame:
    """Markov clustering (van Dongen, 2000) of the graph of pairs nearer than threshold, with loops of weight 1 and edges by flow_weight.

    The flow is a sparse table (source, target, share). A round takes two steps
    at once (a join of the table with itself and a sum), raises shares to the
    power of inflation and scales each source's to 1; shares below prune go, so
    that a source has few targets. It ends when no share changes by more than
    ten times prune, or after rounds. A cluster is what has the same least attractor.
    """
    edges = pairs.where(F.col("distance") < threshold).select("block", F.col("a").alias("s"), F.col("b").alias("t"), flow_weight(F.col("distance")).alias("w")).where("w > 0")
    both = edges.union(edges.select("block", F.col("t").alias("s"), F.col("s").alias("t"), "w"))
    loops = both.select("block", "s").distinct().select("block", "s", F.col("s").alias("t"), F.lit(1.0).alias("w"))
    flow = kept(_scaled(both.union(loops)))
    for _ in range(rounds):
        second = flow.select("block", F.col("s").alias("m"), "t", F.col("w").alias("w2"))
        twice = flow.select("block", "s", F.col("t").alias("m"), "w").join(second, ["block", "m"]).groupBy("block", "s", "t").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
        new = kept(_scaled(_scaled(twice.withColumn("w", F.pow("w", inflation))).where(F.col("w") >= prune)))
        gone = flow.select("block", "s", "t", F.col("w").alias("old"))
        moved = new.join(gone, ["block", "s", "t"], "full_outer").where(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) > 10 * prune)
        flow, done = new, moved.isEmpty()
        if done:
            break
    drawn = flow.groupBy("block", F.col("s").alias("node")).agg(F.min("t").alias("t"))
    return drawn.join(drawn.groupBy("block", "t").agg(F.min("node").alias("root")), ["block", "t"]).select("block", "node", "root")


def _scaled(flow: DataFrame) -> DataFrame:
    whole = flow.groupBy("block", "s").agg(F.sum("w").alias("whole"))
    return flow.join(whole, ["block", "s"]).select("block", "s", "t", (F.col("w") / F.col("whole")).alias("w"))


METHODS = ("upgma", "single", "complete", "mcl", "dbscan")


def flat_clusters(pairs: DataFrame, threshold: float, method: str = "upgma") -> DataFrame:
    """Clusters of each block by upgma, single or complete linkage, mcl or dbscan (of single items: that is single linkage)."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method} (known: {', '.join(METHODS)})")
    if method == "mcl":
        return flow_clusters(pairs, threshold)
    if method == "dbscan":
        return density_clusters(pairs, threshold)
    return linkage_clusters(pairs, threshold, "average" if method == "upgma" else method)


def item_clusters(items: DataFrame, distances: DataFrame, threshold: float, method: str = "upgma") -> DataFrame:
    """The clusters that flat_clusters finds for the pairs of all items of a block, without a table of these pairs.

    items: block, node (each once in its block), key (an integer) and apart:
    items of a block with the same apart have no distance, as have those of keys
    without one. distances: key_a, key_b (key_a <= key_b) and distance, once for
    all blocks. Blocks of MOST items at most are dealt into bins, which meet the
    distinct distances of their blocks' keys; each block is one matrix. A bin
    has BIN_PAIRS distances and BIN_ITEMS items, about. Larger blocks, and other methods than
    upgma and complete, take tables of pairs.
    """
    items = kept(items.select("block", "node", "key", "apart"))
    sizes = items.groupBy("block").agg(F.count("*").alias("n"))
    small = (F.col("n") <= MOST) & F.lit(method in ("upgma", "complete"))
    whole = F.when(small, F.col("n"))
    of = sizes.agg(F.sum(whole * whole / 2).alias("pairs"), F.sum(whole).alias("items"), F.count(F.when(~small, True)).alias("large")).first()
    found = []
    if of["large"]:
        side = lambda s: items.join(sizes.where(~small), "block", "left_semi").select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "key", "apart")])
        both = side("a").join(side("b"), "block").where("node_a < node_b").withColumns({"key_a": F.least("key_a", "key_b"), "key_b": F.greatest("key_a", "key_b")})
        distance = F.when(F.coalesce(F.col("apart_a") != F.col("apart_b"), F.lit(True)), F.col("distance"))
        pairs = both.join(distances, ["key_a", "key_b"], "left").select("block", F.col("node_a").alias("a"), F.col("node_b").alias("b"), distance.alias("distance"))
        found.append(flat_clusters(pairs, threshold, method))
    if of["items"] or not found:
        # bins move their distinct distances: a sixteenth of the pairs at most, where that is not fewer bins than tasks
        n, keys = tasks(items.sparkSession), items.select("key").distinct().count()
        pairs, most = of["pairs"] or 0, max(keys * keys / 2, 1)
        bins = int(max(n, min(8 * n, pairs // (16 * most)), pairs // BIN_PAIRS + 1 if most > BIN_PAIRS else 1, (of["items"] or 0) // BIN_ITEMS + 1))
        placed = items.join(sizes.where(small).select("block"), "block", "left_semi").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int"))
        known = key_pairs(placed, True, ("bin",)).join(distances, ["key_a", "key_b"]).select("bin", "key_a", "key_b", F.col("distance").cast("double").alias("distance"))
        # columns of their own: both sides come from the same table; short rows make much work, so tasks are not put together by size
        placed, known = (t.toDF(*t.columns).repartition(n, "bin") for t in (placed, known))
        kinds = dict(items.dtypes)
        schema = f"block {kinds['block']}, node {kinds['node']}, root {kinds['node']}"
        found.append(placed.groupBy("bin").cogroup(known.groupBy("bin")).applyInArrow(_matrix_clusters(threshold, "average" if method == "upgma" else method), schema))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _matrix_clusters(threshold: float, linkage: str):
    """A function of a bin's items and distances: block, node and root of items that share their cluster."""

    def run(items: pa.Table, known: pa.Table) -> pa.Table:
        items = items.sort_by([("block", "ascending"), ("node", "ascending")]).combine_chunks()
        keys, at = np.unique(items["key"].to_numpy(), return_inverse=True)
        a, b = (np.searchsorted(keys, known[c].to_numpy()) for c in ("key_a", "key_b"))
        distance = known["distance"].to_numpy()
        distance = np.where(np.isnan(distance), np.inf, distance)
        if len(keys) <= DENSE:
            table = np.full((len(keys), len(keys)), np.inf)
            table[a, b] = table[b, a] = distance
            look = lambda k: table[np.ix_(k, k)]
        else:
            codes = np.append(a * len(keys) + b, len(keys) ** 2)
            order = np.argsort(codes)
            codes, values = codes[order], np.append(distance, np.inf)[order]

            def look(k: np.ndarray) -> np.ndarray:
                wanted = np.minimum(k[:, None], k) * len(keys) + np.maximum(k[:, None], k)
                place = np.searchsorted(codes, wanted)
                return np.where(codes[place] == wanted, values[place], np.inf)

        names = [str(x) for x in items["node"].to_pylist()]
        blocks = items["block"].dictionary_encode().combine_chunks()
        of = (blocks.chunk(0) if isinstance(blocks, pa.ChunkedArray) else blocks).indices.to_numpy() if len(names) else np.zeros(0, int)
        ends = np.flatnonzero(np.diff(of, append=-1)) + 1
        single = items["apart"].is_null().to_numpy()
        apart = items["apart"].dictionary_encode().combine_chunks()
        apart = (apart.chunk(0) if isinstance(apart, pa.ChunkedArray) else apart).indices.fill_null(-1).to_numpy(zero_copy_only=False) if len(names) else of
        root = np.arange(len(names))
        for start, end in zip([0, *ends], ends):
            own = slice(start, end)
            total = look(at[own])
            if not single[own].all():
                total[(apart[own, None] == apart[own]) & ~single[own, None]] = np.inf
            root[own] = start + merged_in_rounds(total, names[own], threshold, linkage, DECIMALS)
        shared = np.flatnonzero(np.bincount(root, minlength=len(names))[root] > 1)
        return pa.table({"block": items["block"].take(shared), "node": items["node"].take(shared), "root": items["node"].take(root[shared])})

    return run
