"""Near-duplicates: SimHash links, verified and completed by the exact similarity (Jaccard) of shingle sets.

Texts within a radius of bits of each other's fingerprint meet by the
generalised pigeonhole of simhash.links(). Every candidate is verified on the
sets of 64-bit hashes of its shingles. A pair of similarity 0.8 may be 16 to 18
of 64 bits apart, for which no pigeonhole is selective, so the classes are
completed: what is still apart meets if it shares one of BANDS bands of ROWS
minima of hashes. A pair of similarity s is missed there with probability
(1 - s ** ROWS) ** BANDS, which is 0.0004 at 0.8 and 0.00001 at 0.85, whatever
the number of texts. No bucket's pairs are all made: see classes().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .bpe import blocks, forget
from .common import materialise
from .components import components

BANDS, ROWS = 20, 5
#: Keys with more than this part of all rows are common; there are fewer than it says.
COMMON = 4096
#: Pairs that meet the set of one text in one task; more are dealt out.
PAIRS = 256

_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def band_keys(values: np.ndarray) -> list[int]:
    """A key for each band of a set's minima; none for the empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1 << 12):
        least = np.minimum(least, (values[at : at + (1 << 12)] * _FACTORS + _SHIFTS).min(axis=1))
    return [simhash.signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """All columns, and __key (of the shingle set), __size, __bands and __fp (simhash.fingerprint()) of every row; null text: as empty."""
    at, names = docs.columns.index(text_col), [*docs.columns, "__key", "__size", "__bands", "__fp"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__key bigint", "__size int", "__bands array<bigint>", "__fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, texts in blocks(batches, at, 1 << 22):
            keys, sizes, bands, prints = [], [], [], []
            for text in texts:
                found = simhash.shingles(text, shingle)
                prints += simhash.combined(found)
                values = np.unique(found)
                keys.append(simhash.signed(xxhash.xxh64_intdigest(values.tobytes(), 42)))
                sizes.append(len(values))
                bands.append(band_keys(values))
            arrays = [*batch.columns, pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """key and set (array of hashes) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, found in blocks(batches, 1, 1 << 22):
            values = [np.unique(simhash.shingles(t, shingle)).view(np.int64) for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], ["key", "set"])

    return texts.mapInArrow(run, "key bigint, set array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) whose sets are similar; what many pairs share is b, so b's set is dealt out where they are too many for a task."""
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    total = pairs.count()
    # fewer than COMMON
    often = counts.where((F.col("n") > PAIRS) & (F.col("n") > total / COMMON)).select("b", F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(often), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    parts = counts.join(F.broadcast(often), "b", "left").select("b", F.coalesce("parts", F.lit(1)).alias("parts"))
    others = sets.join(parts, sets["key"] == parts["b"]).select("b", F.col("set").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("key").alias("a"), "set"), "a").join(others, ["b", "part"])
    shared = F.size(F.array_intersect("set", "other"))
    return both.where(shared / (F.size("set") + F.size("other") - shared) >= similarity).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes (key, size, class) of different classes that may be similar: none that is, is missing.

    Prefix filtering with positions (Xiao et al., 2008). The hashes of a set are
    ordered by how few of the nodes have them. Of similar sets the rarest of the
    shorter one, as many as it need not share with a set of its size, and the
    rarest of the longer one, as many as it need not share at all, have a hash in
    common, after which enough of both is left. So texts made from one pattern
    that are not similar do not meet: what each has alone comes first.
    """
    tokens = sets.join(nodes, "key").select("key", "size", "class", F.explode("set").alias("token"))
    counts = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than COMMON
    often = F.broadcast(counts.where(F.col("n") > total / COMMON))
    usual = tokens.join(often.select("token"), "token", "left_anti").join(counts.where(F.col("n") <= total / COMMON), "token")
    size = F.col("size")
    own = tokens.join(often, "token").unionByName(usual).groupBy("key", "size", "class").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rest"))
    probe, index = (size - F.ceil(share * size - 1e-9) + 1 for share in (similarity, 2 * similarity / (1 + similarity)))
    own = own.withColumn("alone", size - F.size("rest")).where(F.col("alone") < probe)
    prefix = F.expr("slice(rest, 1, int(prefix))")
    placed = own.withColumn("prefix", probe - F.col("alone")).select("key", "size", "class", "alone", F.posexplode(prefix).alias("place", "t"))
    placed = materialise(placed.select("key", "size", "class", (F.col("alone") + F.col("place") + 1).alias("place"), "t.token"), "prefixes")
    y = placed.select("token", *[F.col(c).alias(f"y_{c}") for c in ("key", "size", "class", "place")])
    x = placed.where(F.col("place") <= index).select("token", *[F.col(c).alias(f"x_{c}") for c in ("key", "size", "class", "place")])
    shorter = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_key") < F.col("y_key")))
    least = similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-9
    left = 1 + F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    alike = (x["token"] == y["token"]) & (F.col("x_class") != F.col("y_class")) & shorter & (F.col("x_size") >= similarity * F.col("y_size") - 1e-9) & (left >= least)
    return x.join(y, alike).select(F.col("x_key").alias("a"), F.col("y_key").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes (__key, fp) whose fingerprints are equal or linked, that join all that chains of links join."""
    first = nodes.groupBy("fp").agg(F.min("__key").alias("first"))
    values = materialise(first, "fingerprints")
    same = nodes.join(values, "fp").where(F.col("__key") != F.col("first")).select(F.col("__key").alias("a"), F.col("first").alias("b"))
    found = simhash.links(values.select(F.col("fp").alias("__fp")), radius, direct=True)
    ends = [values.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(f"first_{c}")) for c in "ab"]
    across = found.join(ends[0], F.col("a") == F.col("fp_a")).join(ends[1], F.col("b") == F.col("fp_b"))
    return same.union(across.select("first_a", "first_b").distinct())


def classes(marked: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int = 3) -> DataFrame:
    """__key, root (a key that names the class) and component_id (its least id) of every distinct shingle set of signatures().

    fingerprint_pairs() come first. In the buckets of bands that hold several
    classes then, each text meets the one of it that meets most others, and the
    next in that order, which is linear and joins most of what is alike; the
    texts of buckets that are still in different classes then meet by
    prefix_pairs, so that the classes are those of all candidate pairs at least.
    """
    found = marked.groupBy("__key").agg(F.min(id_col).alias("__least"), F.first("__size").alias("size"), F.first("__bands").alias("bands"), F.min("__fp").alias("fp"))
    nodes = materialise(found, "shingle-sets")
    near = materialise(fingerprint_pairs(nodes, radius), "near")
    met = nodes.select(F.col("__key").alias("key"), "size", F.explode("bands").alias("bucket"))
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    # the text that a group was copied from is in the largest buckets
    met = materialise(met.withColumn("meets", F.sum("n").over(Window.partitionBy("key"))).drop("n"), "buckets")
    wanted = met.select("key").union(near.select("a")).union(near.select("b")).distinct()
    needed = wanted.join(nodes, F.col("key") == F.col("__key")).select("key", "__least")
    texts = marked.join(needed, (F.col("__key") == F.col("key")) & F.col(id_col).eqNullSafe(F.col("__least")))
    sets = materialise(_sets(texts.select("key", text_col), shingle).dropDuplicates(["key"]), "sets")
    edges = materialise(_linked(near, sets, similarity), "simhash-links")

    def apart(edges: DataFrame) -> DataFrame:
        """met and class of the buckets that hold several classes."""
        joined = components(edges, "a", "b")
        named = met.join(joined, met["key"] == joined["node"], "left").select(*met.columns, F.coalesce("root", "key").alias("class"))
        several = named.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("greatest")).where("least <> greatest")
        return materialise(named.join(several.select("bucket"), "bucket"), "apart")

    order = Window.partitionBy("bucket").orderBy(F.desc("meets"), "key")
    node = F.struct("key", "class")
    stars = apart(edges).withColumn("first", F.first(node).over(order)).withColumn("last", F.lag(node).over(order))
    stars = stars.select(F.col("key").alias("a"), "class", F.explode(F.array("first", "last")).alias("other")).where("other.class <> class")
    stars = materialise(stars.select("a", F.col("other.key").alias("b")).distinct(), "stars")
    edges = edges.union(materialise(_linked(stars, sets, similarity), "links"))
    left = apart(edges)
    rest = materialise(prefix_pairs(left.select("key", "size", "class").distinct(), sets, similarity), "rest")
    more = materialise(_linked(rest, sets, similarity), "links")
    joined = components(edges.union(more), "a", "b")
    of = nodes.join(joined, nodes["__key"] == joined["node"], "left").select("__key", F.coalesce("root", "__key").alias("root"), "__least")
    least = of.groupBy("root").agg(F.min("__least").alias("component_id"))
    return of.select("__key", "root").join(least, "root")
