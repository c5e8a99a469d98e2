"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Vectors are scaled to integers and cut into equal parts; each part position has
a codebook that some rounds of Lloyd's method refine. In each round the driver
puts a codebook's entries into a kd-tree and broadcasts it; tasks look up their
parts by branch and bound, many vectors at a time, and sum up the parts of each
entry; the sums (integers, so no order of adding matters) are added up by Spark
and only they come back. A node whose bound equals the best distance is visited
too, so of equally near entries the one with the lowest number always wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Entries of a kd-tree's leaf, which are compared one by one.
LEAF = 16
#: Scaled components are held within this bound of a long.
WIDEST = 2**62
#: Labels up to this number are broadcast with their sums; more are joined by a shuffle.
LABELS = 100_000


@dataclass
class Node:
    """A box around some entries; a leaf has their numbers, another node its two halves."""

    low: np.ndarray
    high: np.ndarray
    numbers: np.ndarray | None = None
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, numbers: np.ndarray | None = None) -> Node:
    """Halves the entries at the median of the widest axis until few are left."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    own = entries[numbers]
    node = Node(own.min(axis=0), own.max(axis=0), numbers)
    if len(numbers) <= LEAF or (node.low == node.high).all():
        node.numbers = np.sort(numbers)
        return node
    axis = int(np.argmax([int(h) - int(l) for h, l in zip(node.high, node.low)]))
    order = np.argsort(own[:, axis], kind="stable")
    middle = len(order) // 2
    node.numbers, node.axis, node.cut = None, axis, int(own[order[middle], axis])
    node.left, node.right = kd_tree(entries, numbers[order[:middle]]), kd_tree(entries, numbers[order[middle:]])
    return node


def nearest(tree: Node, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each part's nearest entry; of equally near ones the lowest number."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # doubles hold integers below 2^53 exactly; beyond, Python's integers
    kind = np.float64 if parts.shape[1] * (2 * most) ** 2 < 2**53 else object
    parts, entries = parts.astype(kind), entries.astype(kind)
    own, squares = (parts * parts).sum(axis=1), (entries * entries).sum(axis=1)
    best, found = np.full(len(parts), np.inf, kind), np.full(len(parts), len(entries))

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        some = parts[rows]
        out = np.maximum(np.maximum(node.low.astype(kind) - some, some - node.high.astype(kind)), 0)
        return (out * out).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.numbers is None:
            first = parts[rows, node.axis] < node.cut
            for near, some, other in ((node.left, rows[first], node.right), (node.right, rows[~first], node.left)):
                visit(near, some)
                # a bound equal to the best distance is no reason to turn back: a lower number may be there
                visit(other, some[bound(other, some) <= best[some]])
            return
        apart = own[rows, None] - 2 * (parts[rows] @ entries[node.numbers].T) + squares[node.numbers]
        at = apart.argmin(axis=1)
        d, number = apart[np.arange(len(rows)), at], node.numbers[at]
        better = (d < best[rows]) | ((d == best[rows]) & (number < found[rows]))
        best[rows[better]], found[rows[better]] = d[better], number[better]

    visit(tree, np.arange(len(parts)))
    return found, best.astype(np.int64) if kind is np.float64 else np.array([min(x, 2**63 - 1) for x in best], np.int64)


@dataclass
class Codebooks:
    """For each part position the entries (numbers x components) and their tree; of a size that the parameters fix."""

    entries: list[np.ndarray]
    trees: list[Node]

    @classmethod
    def of(cls, entries: list[np.ndarray]) -> Codebooks:
        return cls(entries, [kd_tree(e) for e in entries])

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances (vectors x part positions) of integer vectors."""
        found = [nearest(t, e, p) for t, e, p in zip(self.trees, self.entries, np.split(parts, len(self.entries), axis=1))]
        return np.stack([n for n, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def digest(self) -> str:
        """SHA-256 of all components in decimals by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for row in e.tolist() for x in row).encode()).hexdigest()


def scaled(column: str, scale: int) -> Column:
    """floor(scale * x) of every component as long, within WIDEST."""
    return F.transform(column, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(WIDEST)), F.lit(-WIDEST)).cast("long"))


def usable(column: str) -> Column:
    """True for a vector that is not null or empty and has neither null nor infinite components nor NaN."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, ok) & (F.size(column) > 0), F.lit(False))


def _refined(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: entries become the floors of their parts' means, unused ones stay."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    width = books.entries[0].shape[1]
    names = [f"{x}{d}" for d in range(width) for x in ("high", "low")]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        size = max(map(len, books.entries))
        total = np.zeros((len(books.entries), size, 2 * width), np.int64)
        count = np.zeros((len(books.entries), size), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch.parts.to_numpy())
            numbers, _ = books.assign(vectors)
            for part, own in enumerate(np.split(vectors, len(books.entries), axis=1)):
                count[part] += np.bincount(numbers[:, part], minlength=size)
                # two halves of 31 bits and the rest: sums cannot overflow
                np.add.at(total[part], numbers[:, part], np.stack([own >> 31, own & (2**31 - 1)], axis=2).reshape(len(own), -1))
        part, entry = np.nonzero(count)
        out = pd.DataFrame(total[part, entry], columns=names)
        yield out.assign(part=part.astype(np.int32), entry=entry.astype(np.int32), n=count[part, entry])

    schema = ", ".join([*(f"{n} bigint" for n in names), "part int", "entry int", "n bigint"])
    added = kept.select("parts").mapInPandas(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in [*names, "n"]])
    entries = [e.copy() for e in books.entries]
    # a row for each entry in use, whatever the input
    for row in added.collect():
        entries[row["part"]][row["entry"]] = [((row[f"high{d}"] << 31) + row[f"low{d}"]) // row["n"] for d in range(width)]
    return Codebooks.of(entries)


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codebooks | None]:
    """id_col, label_col, codes (array of parts numbers), error and label_error of every vector kept, and the codebooks.

    Vectors that are null, empty, or hold null, NaN or infinite components are
    dropped, and so are those whose length is not that of the first one kept (by
    id) or cannot be cut into parts. Components become floor(scale * x), held
    within 2^62. Codebooks begin with the parts of the size smallest ids (ties,
    as in repeated rows: by components; null ids last); fewer vectors make
    fewer entries. Error is the squared distance summed over the parts (at most
    2^63 - 1), label_error its sum over the rows with an equal label, nulls
    together. Repeated rows each give a row; other columns are not used; no
    vector kept: no rows, and no codebooks.
    """
    whole = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector_col, scale).alias("parts"))
    kept = materialise(whole, "vectors")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "parts").limit(1).collect()
    length = len(first[0]["parts"]) if first else 0
    typed = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, `{label_col}` {vectors.schema[label_col].dataType.simpleString()}"
    if not length or length % parts:
        return vectors.sparkSession.createDataFrame([], f"{typed}, codes array<int>, error bigint, label_error bigint"), None
    kept = kept.where(F.size("parts") == length)
    # size rows
    seeds = np.array([r["parts"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "parts").limit(size).collect()], np.int64)
    books = Codebooks.of([p.copy() for p in np.split(seeds, parts, axis=1)])
    for _ in range(rounds):
        books = _refined(kept, books)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                numbers, apart = shared.value.assign(np.stack(batch.parts.to_numpy()))
                # no sum beyond a long
                error = [min(sum(map(int, row)), 2**63 - 1) for row in apart]
                yield pd.DataFrame({"id": batch.id, "label": batch.label, "codes": list(numbers.astype(np.int32)), "error": error})

    kinds = dict(kept.dtypes)
    coded = kept.mapInPandas(code, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error bigint")
    coded = materialise(coded, "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    few = sums.limit(LABELS + 1).count() <= LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books
