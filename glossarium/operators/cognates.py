"""Cognate detection: blocked word pairs, correspondences, log-odds scorers and clusters within concepts.

Words are compared within a concept only. Pairs are made over distinct forms,
kernels run on distinct pairs of forms in Arrow functions, and results are
joined back; counts and log-odds are aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align as al
from ..functions import sounds
from ..functions.clusters import flat_cluster, order_labels
from ..functions.ngrams import segments
from . import lexstat
from .graphs import components, kept
from .lexstat import segmented, spread
from .linkage import flat_clusters, item_clusters, key_pairs, linked, tasks
from .table import number_rows, word_pairs

Distance = Callable[[list[str], list[str]], float]


def sca_distance(a: list[str], b: list[str], mode: str = "overlap", gop: float = -2.0, scale: float = 0.5, factor: float = 0.3) -> float:
    """Distance of an alignment by sound classes: 10 for equal classes (5 for vowels), prosodic gap weights and bonus."""
    ca, cb = [sounds.sound_class(t) for t in a], [sounds.sound_class(t) for t in b]
    pa, pb = sounds.prosody(a), sounds.prosody(b)
    vowel = lambda x: x in ("V", "1")
    scorer = lambda x, y: (5.0 if vowel(x) else 10.0) if x == y else -5.0 if vowel(x) == vowel(y) else -10.0
    return al.align_pair(ca, cb, scorer, gop, scale, mode, sounds.gap_weights(pa), sounds.gap_weights(pb), pa, pb, factor, "T_")[3]


def edit_distance(a: list[str], b: list[str]) -> float:
    s = np.array([[0.0 if x == y else -1.0 for y in b] for x in a]).reshape(len(a), len(b))
    return -al.align(s, [-1.0] * len(a), [-1.0] * len(b), "global", 1.0)[1] / max(len(a), len(b), 1)


#: Distances by method name.
DISTANCES: dict[str, Distance] = {"sca": sca_distance, "edit-dist": edit_distance, "turchin": lambda a, b: float(sounds.turchin(a, b))}


#: Distances that are worked out for batches of pairs.
BATCHED = {"sca": lexstat.class_distances, "edit-dist": lexstat.edit_distances}


def form_distances(pairs: DataFrame, method: str | Distance = "sca", a: str = "entry_a", b: str = "entry_b") -> DataFrame:
    """a, b and distance of every distinct pair of forms; forms that cannot be compared have distance 1."""
    batched = BATCHED.get(method) if isinstance(method, str) else None
    distance = DISTANCES[method] if isinstance(method, str) else method

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if batched:
                yield rows.assign(distance=batched(rows[a], rows[b]))
                continue
            split = {w: segmented(w) for w in {*rows[a], *rows[b]}}
            # empty forms cannot be compared
            found = [distance(split[x], split[y]) if split[x] and split[y] else 1.0 for x, y in zip(rows[a], rows[b])]
            yield rows.assign(distance=np.array(found, float))

    return spread(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)).mapInPandas(measure, f"`{a}` string, `{b}` string, distance double")


def doculect_distances(df: DataFrame, method: str | Distance = "sca") -> DataFrame:
    """Mean distance of the word pairs of every two doculects (a < b)."""
    pairs = word_pairs(df)
    return pairs.join(form_distances(pairs, method), ["entry_a", "entry_b"]).groupBy("a", "b").agg(F.avg("distance").alias("distance"), F.count("*").alias("pairs"))


def correspondences(df: DataFrame, threshold: float = 0.7, mode: str = "overlap", gop: float = -2.0) -> DataFrame:
    """How often segments x of doculect a and y of b meet in alignments of word pairs within threshold ('-' is a gap): a, b, x, y, n."""

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for p, q in zip(rows.entry_a, rows.entry_b):
                x, y = segmented(p), segmented(q)
                if edit_distance(x, y) <= threshold:
                    out.append((p, q, *al.align_pair(x, y, None, gop / 2, 0.5, mode)[:2]))
            yield pd.DataFrame(out, columns=["entry_a", "entry_b", "x", "y"])

    pairs = word_pairs(df)
    kept = spread(pairs.select("entry_a", "entry_b")).mapInPandas(aligned, "entry_a string, entry_b string, x array<string>, y array<string>")
    counted = pairs.groupBy("a", "b", "entry_a", "entry_b").agg(F.count("*").alias("times"))
    columns = counted.join(kept, ["entry_a", "entry_b"]).select("a", "b", "times", F.explode(F.arrays_zip("x", "y")).alias("c"))
    return columns.groupBy("a", "b", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("times").alias("n"))


def expected_correspondences(attested: DataFrame) -> DataFrame:
    """What chance alone gives for each pair of segments: the product of their shares times the doculects' total (a, b, x, y, n)."""
    total = attested.groupBy("a", "b").agg(F.sum("n").alias("total"))
    xs = attested.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    ys = attested.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    # segments of two doculects: an alphabet each
    return xs.join(ys, ["a", "b"]).join(total, ["a", "b"]).select("a", "b", "x", "y", (F.col("nx") * F.col("ny") / F.col("total")).alias("n"))


def shuffled_correspondences(df: DataFrame, seed: int, runs: int = 10, **options) -> DataFrame:
    """Mean correspondences over runs in which each doculect's forms are dealt anew to its concepts."""
    found = None
    for run in range(runs):
        order = Window.partitionBy("doculect").orderBy(F.xxhash64(F.lit(seed), F.lit(run), "id"), "id")
        place = Window.partitionBy("doculect").orderBy("id")
        dealt = df.select("doculect", "form", F.row_number().over(order).alias("k"))
        cells = df.select("id", "doculect", "concept", F.row_number().over(place).alias("k"))
        some = correspondences(cells.join(dealt, ["doculect", "k"]), **options)
        found = some if found is None else found.union(some)
    return found.groupBy("a", "b", "x", "y").agg((F.sum("n") / runs).alias("n"))


def log_odds(attested: DataFrame, expected: DataFrame, smooth: float = 1.0, unseen: float = -5.0, neither: float = -90.0) -> DataFrame:
    """Score of every pair of segments: log2 of the squares' quotient; unseen where they never meet but could, neither where chance has none."""
    e = expected.withColumnRenamed("n", "e")
    joined = attested.withColumnRenamed("n", "n").join(e, ["a", "b", "x", "y"], "full_outer")
    seen = (F.col("n") > smooth) | (F.col("x") == F.col("y"))
    score = F.when(F.col("n").isNotNull() & seen & F.col("e").isNotNull(), F.log2(F.col("n") * F.col("n") / (F.col("e") * F.col("e"))))
    score = score.when(F.col("n").isNotNull() & seen, F.log2(F.col("n") * F.col("n") / F.lit(1e-5))).when(F.col("e").isNotNull(), unseen).otherwise(neither)
    return joined.select("a", "b", "x", "y", score.alias("score"))


def cluster(df: DataFrame, method: str | Distance = "sca", linkage: str = "upgma", threshold: float = 0.45, name: str = "clusterid") -> DataFrame:
    """df with the cluster of each word: words of a concept whose forms are near by the distance and linkage.

    Distinct forms of a concept are clustered by rounds over the table of their
    distances (operators.linkage); its words, however many, only join in the
    labels, "concept:least form of the cluster". Linkage is one of
    linkage.METHODS, or infomap or ward: these two need a concept's forms in one
    matrix, so one group holds them, and their labels are "concept:number".
    """
    forms = df.select("concept", "form").distinct()
    a, b = forms.withColumnRenamed("form", "entry_a"), forms.withColumnRenamed("form", "entry_b")
    pairs = a.join(b, "concept").where("entry_a < entry_b")
    measured = pairs.join(form_distances(pairs, method), ["entry_a", "entry_b"]).select("concept", "entry_a", "entry_b", "distance")
    if linkage not in ("infomap", "ward"):
        table = measured.select(F.col("concept").alias("block"), F.col("entry_a").alias("a"), F.col("entry_b").alias("b"), "distance")
        return with_clusters(df, flat_clusters(table, threshold, linkage), name)
    alone = forms.select("concept", F.col("form").alias("entry_a"), F.col("form").alias("entry_b"), F.lit(0.0).alias("distance"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows.entry_a) | set(rows.entry_b))
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = rows.entry_a.map(at).to_numpy(), rows.entry_b.map(at).to_numpy()
        d[i, j] = d[j, i] = rows.distance
        return pd.DataFrame({"concept": rows.concept.iloc[0], "form": names, "label": order_labels(flat_cluster(d, threshold, linkage))})

    labels = measured.union(alone).groupBy("concept").applyInPandas(run, "concept string, form string, label int")
    return df.join(labels, ["concept", "form"]).select(*df.columns, F.concat_ws(":", "concept", F.col("label").cast("string")).alias(name))


def form_pairs(df: DataFrame, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """block (the concept), a, b and distance of every two forms of a concept, by a native distance of their characters.

    A distance is worked out once for two forms, whatever concepts share them.
    """
    forms = df.select(F.col("concept").alias("block"), "form").distinct()
    pairs = forms.withColumnRenamed("form", "a").join(forms.withColumnRenamed("form", "b"), "block").where("a < b")
    # segments as columns of their own: a distance uses them many times
    split = spread(pairs.select("a", "b")).select("a", "b", segments_of("a").alias("p"), segments_of("b").alias("q"))
    measured = split.select("a", "b", distance(F.col("p"), F.col("q")).alias("distance"))
    return pairs.join(measured, ["a", "b"]).select("block", "a", "b", "distance")


def with_clusters(df: DataFrame, found: DataFrame, name: str = "clusterid") -> DataFrame:
    """df with "concept:least form" of each word's cluster; found: block, node and root of forms that are not alone."""
    labels = found.select(F.col("block").alias("concept"), F.col("node").alias("form"), "root")
    named = F.concat_ws(":", "concept", F.coalesce("root", "form")).alias(name)
    return df.join(labels, ["concept", "form"], "left").select(*df.columns, named)


def single_linkage(df: DataFrame, distance: Callable[[Column, Column], Column], threshold: float, name: str = "clusterid") -> DataFrame:
    """df with single-linkage clusters by a native distance: the connected forms of each concept, named by the least form."""
    return with_clusters(df, linked(form_pairs(df, distance).where(F.col("distance") <= threshold)), name)


def segments_of(column: str) -> Column:
    return F.filter(F.split(column, ""), lambda c: c != "")


def partial_slices(df: DataFrame, column: str = "segments", separators: tuple[str, ...] = ("+", "_", "◦")) -> DataFrame:
    """A row for each morpheme of a word: id, part (from 0) and its segments."""
    text = F.array_join(F.transform(column, lambda t: F.when(t.isin(*separators), "\u0001").otherwise(t)), "\u0002")
    parts = F.filter(F.split(text, "\u0001"), lambda p: F.replace(p, F.lit("\u0002"), F.lit("")) != "")
    return df.select("id", *[c for c in ("doculect", "concept") if c in df.columns], F.posexplode(parts).alias("part", "p")).select(
        "*", F.filter(F.split("p", "\u0002"), lambda t: t != "").alias("morpheme")
    ).drop("p")


def partial_clusters(
    df: DataFrame, distance: Callable[[Column, Column], Column], threshold: float, column: str = "segments", linkage: str = "upgma", name: str = "partialids"
) -> DataFrame:
    """df with an array of clusters, one for each morpheme of a word: "concept:least morpheme's word id/part".

    Morphemes of a concept's words are clustered by a native, symmetric distance of their
    segments, worked out once for two distinct morphemes. Two of one word have
    no distance, which keeps them, and so all that holds them, apart: a word has
    each cluster once at most. A word without segments has a null array.
    """
    node = F.format_string("%019d/%04d", "id", "part")
    parts = kept(partial_slices(df.select("id", "concept", column).repartition(tasks(df.sparkSession)), column).select("id", "concept", "part", "morpheme", node.alias("node")))
    bucket = F.pmod(F.xxhash64("morpheme"), F.lit(1024))
    numbered = kept(number_rows(parts.select("morpheme").distinct().withColumn("bucket", bucket), ["bucket", "morpheme"], name="key").select("key", "morpheme"))
    items = kept(parts.join(numbered, "morpheme").where("concept is not null").select(F.col("concept").alias("block"), "node", "key", F.col("id").alias("apart")))
    a, b = numbered.toDF("key_a", "morpheme_a"), numbered.toDF("key_b", "morpheme_b")
    measured = spread(key_pairs(items, True).join(a, "key_a").join(b, "key_b")).select("key_a", "key_b", distance(F.col("morpheme_a"), F.col("morpheme_b")).alias("distance"))
    found = item_clusters(items, kept(measured), threshold, linkage).select(F.col("block").alias("concept"), "node", "root")
    short = F.regexp_replace(F.coalesce("root", "node"), "0*([0-9]+)/0*([0-9]+)", "$1/$2")
    label = F.struct("part", F.concat_ws(":", "concept", short).alias("label"))
    lists = parts.join(found, ["concept", "node"], "left").groupBy("id").agg(F.array_sort(F.collect_list(label)).alias("l"))
    return df.join(lists.select("id", F.col("l.label").alias(name)), "id", "left").select(*df.columns, name)


def strict_ids(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with one id for each distinct list of partial ids within a concept."""
    rank = F.dense_rank().over(Window.partitionBy("concept").orderBy(F.col(source)))
    return df.withColumn(target, F.concat_ws(":", "concept", rank.cast("string")))


def loose_ids(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with one id for words of a concept that a chain of shared partial ids joins: "concept:least id of the chain".

    A word without partial ids is alone, as "concept:#word's id".
    """
    item = lambda c: F.struct("concept", c.cast("string").alias("item"))
    first = F.array_min(F.transform(source, lambda x: x.cast("string")))
    links = df.where(F.size(source) > 1).select("concept", first.alias("least"), F.explode(source).alias("other")).distinct()
    found = components(links.select(item(F.col("least")).alias("a"), item(F.col("other")).alias("b")), "a", "b")
    roots = found.select("node.concept", F.col("node.item").alias("least"), F.col("root.item").alias("root"))
    words = df.withColumn("least", first).join(roots, ["concept", "least"], "left")
    alone = F.concat(F.lit("#"), F.col("id").cast("string"))
    return words.select(*df.columns, F.concat_ws(":", "concept", F.coalesce("root", "least", alone)).alias(target))
