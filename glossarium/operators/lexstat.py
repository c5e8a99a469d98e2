"""Language-specific sound correspondences: a scorer for every two doculects, distances by it, and clusters.

Segments are symbols of a class and a place in the word ("T.C"). How often
symbols of two doculects meet in alignments of words for one concept is held
against how often they meet in words dealt at random; the log-odds, mixed with
the classes' own scores, are the scorer of these two doculects. Alignments are
made once for every two forms, in batches; all counts are aggregates over
(doculect, doculect, symbol, symbol).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sounds
from ..functions.batches import Sequences, align_all, with_prosody
from .graphs import kept
from .linkage import item_clusters, key_pairs, tasks
from .table import number_rows

GAP = "-"
#: Kinds of places by prosodic symbol: onset, other consonant, vowel, tone, break.
PLACES = dict(zip("ABCLMNXYZT_", "CCCcccVVVT_"))
#: Mode, cost of a gap, and what a gap's going on costs of that.
MODES = (("global", -2.0, 0.5), ("local", -1.0, 0.5))
FACTOR, RESTRICTED = 0.3, "T_"
#: Pairs of one task's block of two doculects, and pairs aligned at once.
BLOCK, BATCH = 20_000, 4096


def segmented(form: str) -> list[str]:
    return form.split() if " " in form else sounds.tokens(form)


def symbols(form: str) -> tuple[list[str], str]:
    """Symbols of a form's segments, and its prosodic string."""
    parts = segmented(form)
    pro = sounds.prosody(parts)
    return [f"{sounds.sound_class(t)}.{PLACES[p]}" for t, p in zip(parts, pro)], pro


def class_score(x: str, y: str) -> float:
    """Score of two classes: 10 if equal (5 for vowels and tones), else -5 for two of these or two consonants, -10 for unlike ones."""
    vowel = x in ("V", "1")
    return (5.0 if vowel else 10.0) if x == y else -5.0 if vowel == (y in ("V", "1")) else -10.0


class Forms:
    """The forms of a block of pairs: numbers of their symbols, weights and prosody, and which forms the pairs are of."""

    def __init__(self, a: pd.Series, b: pd.Series):
        names = sorted({*a, *b})
        known = [symbols(f) for f in names]
        self.alphabet = sorted({s for own, _ in known for s in own})
        number = {s: k for k, s in enumerate(self.alphabet)}
        self.sequences = Sequences.of([[number[s] for s in own] for own, _ in known], [sounds.gap_weights(p) for _, p in known], [p for _, p in known])
        at = {f: k for k, f in enumerate(names)}
        self.a, self.b = a.map(at).to_numpy(np.int64), b.map(at).to_numpy(np.int64)

    def batches(self) -> Iterator[tuple[slice, Sequences, Sequences]]:
        for k in range(0, len(self.a), BATCH):
            own = slice(k, k + BATCH)
            yield own, self.sequences.take(self.a[own]), self.sequences.take(self.b[own])

    def class_scores(self) -> np.ndarray:
        kinds = [s[0] for s in self.alphabet]
        return np.array([[class_score(x, y) for y in kinds] for x in kinds]).reshape(len(kinds), len(kinds))


def _own_scores(table: np.ndarray, s: Sequences) -> np.ndarray:
    inside = np.arange(s.codes.shape[1]) < s.lengths[:, None]
    return (table[s.codes, s.codes] * inside).sum(axis=1) * (1 + FACTOR)


def _distance(score: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.where(own != 0, 1 - 2 * score / np.where(own != 0, own, 1.0), 1.0)


def class_distances(a: pd.Series, b: pd.Series, mode: str = "overlap", gop: float = -2.0, scale: float = 0.5) -> np.ndarray:
    """Distances of all pairs of forms by their classes; 1 where a form has no segments."""
    forms = Forms(a, b)
    table, out = forms.class_scores(), np.ones(len(a))
    for own, x, y in forms.batches():
        if not (x.codes.shape[1] and y.codes.shape[1]):
            continue
        s = with_prosody(table[x.codes[:, :, None], y.codes[:, None, :]], x, y, FACTOR, RESTRICTED, mode == "global")
        score, _ = align_all(s, x.lengths, y.lengths, gop * x.weights, gop * y.weights, mode, scale)
        found = _distance(score, _own_scores(table, x) + _own_scores(table, y))
        out[own] = np.where((x.lengths > 0) & (y.lengths > 0), found, 1.0)
    return out


def edit_distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Normalised edit distances of the segments of all pairs of forms; 1 where a form has no segments."""
    names = sorted({*a, *b})
    known = [segmented(f) for f in names]
    number = {s: k for k, s in enumerate(sorted({s for own in known for s in own}))}
    sequences, at = Sequences.of([[number[s] for s in own] for own in known]), {f: k for k, f in enumerate(names)}
    first, second, out = a.map(at).to_numpy(np.int64), b.map(at).to_numpy(np.int64), np.ones(len(a))
    for k in range(0, len(a), BATCH):
        own = slice(k, k + BATCH)
        x, y = sequences.take(first[own]), sequences.take(second[own])
        if x.codes.shape[1] and y.codes.shape[1]:
            s = np.where(x.codes[:, :, None] == y.codes[:, None, :], 0.0, -1.0)
            score, _ = align_all(s, x.lengths, y.lengths, -x.weights, -y.weights, "global", 1.0)
            out[own] = np.where((x.lengths > 0) & (y.lengths > 0), -score / np.maximum(np.maximum(x.lengths, y.lengths), 1), 1.0)
    return out


def spread(pairs: DataFrame) -> DataFrame:
    """The distinct rows, over as many tasks as the cluster runs at once: few short rows would else be put into one task."""
    return pairs.distinct().repartition(tasks(pairs.sparkSession))


def met_symbols(pairs: DataFrame, modes: tuple = MODES) -> DataFrame:
    """entry_a, entry_b, mode (its number), distance and the aligned symbols x and y of every two distinct forms; pairs: entry_a, entry_b."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            forms = Forms(rows.entry_a, rows.entry_b)
            table, names = forms.class_scores(), np.array([*forms.alphabet, GAP], object)
            for own, x, y in forms.batches():
                if not (x.codes.shape[1] and y.codes.shape[1]):
                    continue
                whole = _own_scores(table, x) + _own_scores(table, y)
                for number, (mode, gop, scale) in enumerate(modes):
                    s = with_prosody(table[x.codes[:, :, None], y.codes[:, None, :]], x, y, FACTOR, RESTRICTED, mode == "global")
                    score, columns = align_all(s, x.lengths, y.lengths, gop * x.weights, gop * y.weights, mode, scale)
                    found = []
                    for places, z in zip(columns(), (x, y)):
                        codes = np.where(places >= 0, np.take_along_axis(z.codes, np.maximum(places, 0), axis=1), len(names) - 1)
                        found.append([names[c[p > -2][::-1]].tolist() for c, p in zip(codes, places)])
                    out = rows.iloc[own][["entry_a", "entry_b"]].assign(mode=number, distance=_distance(score, whole), x=found[0], y=found[1])
                    yield out[((x.lengths > 0) & (y.lengths > 0)).tolist()]

    return spread(pairs.select("entry_a", "entry_b")).mapInPandas(run, "entry_a string, entry_b string, mode int, distance double, x array<string>, y array<string>")


def numbered_nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct forms of all doculects by number (key, doculect, form; in this order), and which of them each concept has (block, key)."""
    words = kept(df.select("concept", "doculect", "form").where("form is not null and doculect is not null").distinct())
    nodes = kept(number_rows(words.select("doculect", "form").distinct(), ["doculect", "form"], name="key"))
    return nodes, words.join(nodes, ["doculect", "form"]).where("concept is not null").select(F.col("concept").alias("block"), "key")


def named_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, entry_a and entry_b of pairs of keys."""
    first, second = nodes.toDF("key_a", "a", "entry_a"), nodes.toDF("key_b", "b", "entry_b")
    return pairs.join(first, "key_a").join(second, "key_b").select("a", "b", "entry_a", "entry_b")


def attested_pairs(df: DataFrame) -> DataFrame:
    """a, b (a <= b), entry_a, entry_b and times (1): every two forms of two doculects for a concept once, and each form of a doculect with itself."""
    nodes, items = numbered_nodes(df)
    between = named_pairs(key_pairs(items), nodes).where("a < b")
    words = df.select("doculect", "form").where("form is not null").distinct()
    own = words.select(F.col("doculect").alias("a"), F.col("doculect").alias("b"), F.col("form").alias("entry_a"), F.col("form").alias("entry_b"))
    return between.union(own).withColumn("times", F.lit(1).cast("long"))


def dealt_pairs(df: DataFrame, runs: int, seed: int) -> DataFrame:
    """a, b, entry_a, entry_b and times: runs pairs of words of every two doculects (a <= b), drawn by hashes of the run's number."""
    words = df.select("doculect", "form", "id").where("form is not null").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(64)))
    numbered = number_rows(words, ["doculect", "bucket", "id", "form"], leading=2, name="place")
    sizes = numbered.groupBy("doculect").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # dimension-sized: two doculects and a run's number
    a, b = sizes.toDF("a", "first_a", "n_a"), sizes.toDF("b", "first_b", "n_b")
    draws = a.join(b, F.col("a") <= F.col("b")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    drawn = lambda side, n, first: F.col(first) + F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "a", "b", "run"), F.col(n))
    places = draws.select("a", "b", drawn(0, "n_a", "first_a").alias("place_a"), drawn(1, "n_b", "first_b").alias("place_b"))
    forms = numbered.select("place", "form")
    joined = places.join(forms.toDF("place_a", "entry_a"), "place_a").join(forms.toDF("place_b", "entry_b"), "place_b")
    return joined.groupBy("a", "b", "entry_a", "entry_b").agg(F.count("*").alias("times"))


def symbol_counts(pairs: DataFrame, met: DataFrame, threshold: float | None, modes: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, x, y, n): how often symbols meet, as the mean over the modes; and (a, b, pairs): the pairs within threshold in the last mode."""
    near = met if threshold is None else met.where(F.col("distance") <= threshold)
    # counted for two forms before these meet all doculects that have them
    cells = near.select("entry_a", "entry_b", F.explode(F.arrays_zip("x", "y")).alias("c")).groupBy("entry_a", "entry_b", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.count("*").alias("met"))
    counts = pairs.join(cells, ["entry_a", "entry_b"]).groupBy("a", "b", "x", "y").agg((F.sum(F.col("times") * F.col("met")) / modes).alias("n"))
    last = near.where(F.col("mode") == modes - 1).select("entry_a", "entry_b")
    return counts, pairs.join(last, ["entry_a", "entry_b"]).groupBy("a", "b").agg(F.sum("times").alias("pairs"))


def base_score(x: Column, y: Column, gap: float) -> Column:
    """class_score of two symbols as an expression; gap where one is a gap."""
    p, q = F.substring(x, 1, 1), F.substring(y, 1, 1)
    vowel = lambda c: c.isin("V", "1")
    plain = F.when(p == q, F.when(vowel(p), 5.0).otherwise(10.0)).when(vowel(p) == vowel(q), -5.0).otherwise(-10.0)
    return F.when((x == GAP) | (y == GAP), gap).otherwise(plain)


def scorer(
    df: DataFrame, seed: int = 0, runs: int = 1000, threshold: float = 0.7, modes: tuple = MODES, ratio: tuple[float, float] = (2.0, 1.0),
    smooth: float = 1.0, unattested: float = -5.0, unexpected: float = 1e-5, neither: float = -90.0, vowels: float = 1.0, real: DataFrame | None = None,
) -> DataFrame:
    """a, b (a <= b), x, y and score of all symbols (and the gap) of every two doculects.

    Attested counts come from words of one concept whose forms are within
    threshold, expected ones from runs pairs of words dealt at random, scaled to
    as many pairs. Between doculects counts up to smooth are as none. Score:
    ratio of log2(attested^2 / expected^2), of attested^2 / unexpected where none is expected,
    unattested or neither where there is none, to the classes' own score (the
    mean gap cost for gaps); that of two vowels times vowels. real: attested_pairs,
    where they are known.
    """
    real, dealt = kept(attested_pairs(df)) if real is None else real, kept(dealt_pairs(df, runs, seed))
    met = kept(met_symbols(real.select("entry_a", "entry_b").union(dealt.select("entry_a", "entry_b")), modes))
    attested, included = symbol_counts(real, met, threshold, len(modes))
    expected, drawn = symbol_counts(dealt, met, None, len(modes))
    scaled = expected.join(included, ["a", "b"]).join(drawn.withColumnRenamed("pairs", "drawn"), ["a", "b"])
    scaled = scaled.select("a", "b", "x", "y", (F.col("n") * F.col("pairs") / F.col("drawn")).alias("e"))
    attested = attested.where((F.col("n") > smooth) | (F.col("a") == F.col("b")))
    # the symbols of a doculect are an alphabet: dimension-sized
    own = kept(met.where("mode = 0 and entry_a = entry_b").select(F.col("entry_a").alias("form"), F.explode("x").alias("s")).distinct())
    alphabet = df.select("doculect", "form").distinct().join(own, "form").select("doculect", "s").distinct()
    alphabet = kept(alphabet.union(alphabet.select("doculect", F.lit(GAP)).distinct()))
    two = drawn.select("a", "b")
    cells = two.join(alphabet.toDF("a", "x"), "a").join(alphabet.toDF("b", "y"), "b")
    n, e = F.col("n"), F.col("e")
    odds = F.when(n.isNotNull() & e.isNotNull(), F.log2(n * n / (e * e))).when(n.isNotNull(), F.log2(n * n / unexpected)).when(e.isNotNull(), unattested).otherwise(neither)
    base = base_score(F.col("x"), F.col("y"), sum(m[1] for m in modes) / len(modes))
    mixed = (ratio[0] * odds + ratio[1] * base) / sum(ratio)
    vowel = F.substring("x", 1, 1).isin("V", "1") & F.substring("y", 1, 1).isin("V", "1")
    joined = cells.join(attested, ["a", "b", "x", "y"], "left").join(scaled, ["a", "b", "x", "y"], "left")
    return joined.select("a", "b", "x", "y", F.when(vowel, mixed * vowels).otherwise(mixed).alias("score"))


def distances(pairs: DataFrame, scores: DataFrame, mode: str = "overlap", gop: float = 2.0, scale: float = 0.5) -> DataFrame:
    """a, b, entry_a, entry_b and distance of distinct pairs of forms of doculects a <= b, by the scorer of these two.

    Pairs of two doculects are dealt into blocks of about BLOCK; each block meets
    its doculects' scores (an alphabet squared) in one task. A gap costs gop
    times the score of the gap and the symbol within the doculect.
    """
    pairs = kept(pairs.select("a", "b", "entry_a", "entry_b").distinct())
    blocks = pairs.groupBy("a", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, ["a", "b"]).withColumn("block", F.pmod(F.xxhash64("entry_a", "entry_b"), F.col("blocks")).cast("int")).drop("blocks")
    within = scores.where(F.col("a") == F.col("b")).where((F.col("x") == F.col("y")) | (F.col("x") == GAP)).select(F.col("a").alias("own"), "x", "y", "score")
    two = blocks.select("a", "b", "blocks")
    parts = [two.join(scores, ["a", "b"]).withColumn("kind", F.lit(0))]
    for kind, side in ((1, "a"), (2, "b")):
        parts.append(two.join(within.withColumnRenamed("own", side), side).select("a", "b", "blocks", "x", "y", "score", F.lit(kind).alias("kind")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # columns of their own: both sides come from the same tables; as many tasks for them, however short the rows
    dealt, rows = (t.toDF(*t.columns).repartition(tasks(t.sparkSession), "a", "b", "block") for t in (dealt, rows))

    def run(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"a": [], "b": [], "entry_a": [], "entry_b": [], "distance": []})
        forms = Forms(own.entry_a, own.entry_b)
        number = {s: k for k, s in enumerate([*forms.alphabet, GAP])}
        table = np.full((3, len(number), len(number)), -90.0)
        x, y = known.x.map(number), known.y.map(number)
        inside = (x.notna() & y.notna()).to_numpy()
        table[known.kind[inside], x[inside].astype(int), y[inside].astype(int)] = known.score[inside]
        gap, out = len(number) - 1, np.ones(len(own))
        for some, p, q in forms.batches():
            if not (p.codes.shape[1] and q.codes.shape[1]):
                continue
            s = with_prosody(table[0][p.codes[:, :, None], q.codes[:, None, :]], p, q, FACTOR, RESTRICTED, mode == "global")
            score, _ = align_all(s, p.lengths, q.lengths, gop * table[1][gap, p.codes], gop * table[2][gap, q.codes], mode, scale)
            found = _distance(score, _own_scores(table[1], p) + _own_scores(table[2], q))
            out[some] = np.where((p.lengths > 0) & (q.lengths > 0), found, 1.0)
        return own[["a", "b", "entry_a", "entry_b"]].assign(distance=out)

    schema = "a string, b string, entry_a string, entry_b string, distance double"
    return dealt.groupBy("a", "b", "block").cogroup(rows.groupBy("a", "b", "block")).applyInPandas(run, schema)


def cluster(df: DataFrame, scores: DataFrame, linkage: str = "upgma", threshold: float = 0.6, name: str = "lexstatid") -> DataFrame:
    """df with the cluster of each word by the scorers' distances: words of a concept, those of one doculect too; "concept:doculect/form" of its least word."""
    node = F.concat_ws("/", "doculect", "form")
    nodes, items = numbered_nodes(df)
    pairs = named_pairs(key_pairs(items), nodes)
    first, second = nodes.toDF("key_a", "a", "entry_a"), nodes.toDF("key_b", "b", "entry_b")
    measured = distances(pairs, scores).join(first, ["a", "entry_a"]).join(second, ["b", "entry_b"]).select("key_a", "key_b", "distance")
    named = items.join(nodes, "key").select("block", node.alias("node"), "key", F.lit(None).cast("long").alias("apart"))
    found = item_clusters(named, kept(measured), threshold, linkage).select(F.col("block").alias("concept"), "node", "root")
    return df.withColumn("node", node).join(found, ["concept", "node"], "left").select(*df.columns, F.concat_ws(":", "concept", F.coalesce("root", "node")).alias(name))
