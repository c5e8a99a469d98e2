"""Quality classifier: votes of the nearest labelled documents in a latent space.

A text becomes two histograms of its bytes, 4-grams of character kinds and
hashed 3-grams, and a mark for the share of its words that repeat the word
before; counts are damped by a logarithm, weighted by inverse document
frequency, and each of the three is scaled to length one. A truncated singular value decomposition
of a bounded sample of labelled texts gives the latent space. The sample's
vectors are broadcast; every document is compared with all of them by blocked
matrix products (exact cosines), and its nearest ones vote with a weight that
grows with the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, forget

SHAPES, GRAMS, SHARES = 8**4, 1 << 12, 16
WIDTH = SHAPES + GRAMS + SHARES
#: Rows that are weighted at a time.
ROWS = 256
#: Damped counts are kept as bytes: this many steps to each power of e.
STEPS = 20

_KIND = np.full(256, 6, np.uint8)
_KIND[[i for i in range(128) if chr(i).islower()]] = 0
_KIND[[i for i in range(128) if chr(i).isupper()]] = 1
_KIND[[i for i in range(128) if chr(i).isdigit()]] = 2
_KIND[[ord(c) for c in " \t\v\f\r"]] = 3
_KIND[[ord(c) for c in ".,;:'\"?!()-"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>@/\\_=+~^{}[]`"]] = 5
_KIND[ord("\n")] = 7


def damped_counts(text: str) -> np.ndarray:
    """The three histograms of the whole text as bytes, about STEPS * log(1 + count)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(WIDTH, np.int64)
    if len(raw) >= 4:
        kind = _KIND[raw].astype(np.int32)
        counts[:SHAPES] = np.bincount(((kind[:-3] * 8 + kind[1:-2]) * 8 + kind[2:-1]) * 8 + kind[3:], minlength=SHAPES)
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        mixed = (wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761)
        counts[SHAPES : SHAPES + GRAMS] = np.bincount(mixed >> 20, minlength=GRAMS)
        words = raw.tobytes().split()
        again = sum(map(eq, words, words[1:]))
        counts[SHAPES + GRAMS + min(SHARES - 1, again * SHARES // max(1, len(words)))] = 1
    return np.minimum(np.rint(STEPS * np.log1p(counts)), 255).astype(np.uint8)


@dataclass
class Voters:
    """The broadcast model: weights of the terms, axes of the latent space, labelled vectors. Its size is bounded by the sample."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def weighted(self, damped: np.ndarray) -> np.ndarray:
        x = damped.astype(np.float32) * self.idf
        for part in np.split(x, [SHAPES, SHAPES + GRAMS], axis=1):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    def times(self, damped: np.ndarray, right: np.ndarray) -> np.ndarray:
        """weighted(damped) @ right, of which only ROWS rows are weighted at a time."""
        return np.concatenate([self.weighted(damped[i : i + ROWS]) @ right for i in range(0, len(damped), ROWS)])

    def turned_times(self, damped: np.ndarray, right: np.ndarray) -> np.ndarray:
        """weighted(damped).T @ right, in the same way."""
        out = np.zeros((WIDTH, right.shape[1]), np.float32)
        for i in range(0, len(damped), ROWS):
            out += self.weighted(damped[i : i + ROWS]).T @ right[i : i + ROWS]
        return out

    def latent(self, damped: np.ndarray) -> np.ndarray:
        z = self.times(damped, self.axes)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, damped: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; a text without terms gets the share of label 1 in the labels."""
        if not len(self.labels):
            return np.full(len(damped), self.prior)
        cosine = self.latent(damped) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(float) ** self.sharpness
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-12, votes / np.where(total > 1e-12, total, 1), self.prior)


def fit(damped: np.ndarray, labels: np.ndarray, prior: float, rank: int, neighbours: int, sharpness: float) -> Voters:
    """Latent space and vectors of the sample: randomised SVD with a fixed seed."""
    seen = (damped > 0).sum(axis=0)
    idf = np.log((1 + len(damped)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    model = Voters(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(float), prior, neighbours, sharpness)
    if not len(damped):
        return model
    n = len(damped)
    rank = min(rank, n)
    basis = model.turned_times(damped, np.random.default_rng(0).standard_normal((n, min(n, rank + 16))).astype(np.float32))
    for _ in range(4):
        basis = np.linalg.qr(model.turned_times(damped, model.times(damped, np.linalg.qr(basis)[0])))[0]
    _, _, turned = np.linalg.svd(model.times(damped, basis), full_matrices=False)
    model.axes = np.ascontiguousarray((basis @ turned[:rank].T).astype(np.float32))
    model.vectors = model.latent(damped)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Damped counts and labels of at most per_label texts of each label, and the share of label 1 in all labels.

    The texts of an id are taken where its label is; ids go in the order of
    their hash. Null ids and labels are not used, repeated ones count once.
    """
    labels = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    shares = {r["__label"]: r["n"] for r in labels.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0), 0.5
    chosen = None
    for value in (0, 1):
        some = labels.where(F.col("__label") == value).dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(per_label)
        chosen = some if chosen is None else chosen.union(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, texts in blocks(batches, 2):
            found = pa.array([damped_counts(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "label", "found"])

    # chosen has at most 2 * per_label rows of two numbers, whatever the input
    rows = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .join(F.broadcast(chosen), "__id")
        .select("__id", "__label", "__text")
        .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, found binary")
        .groupBy("id", "label")
        .agg(F.min("found").alias("found"))
        .orderBy("id", "label")
        .collect()
    )
    damped = np.array([np.frombuffer(r["found"], np.uint8) for r in rows]) if rows else np.zeros((0, WIDTH), np.uint8)
    return damped, np.array([r["label"] for r in rows], float), shares.get(1, 0) / sum(shares.values())


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 1536,
    rank: int = 64,
    neighbours: int = 9,
    sharpness: float = 8.0,
    keep: bool = False,
    examples: DataFrame | None = None,
) -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) of every row's whole text.

    labels: the rows to learn from, already held apart from those to be judged;
    their texts come from examples (docs itself if not given);
    at most per_label of each label are used (the documented bound of the
    sample, which also bounds what is collected and broadcast: per_label * 2
    rows of 8 KB). The score uses the text alone. Null, empty or very short
    text (no 3 bytes): the share of label 1 in labels. No labels: 0.5. Repeated
    rows: one result each. No rows: no rows. Result: id_col, score, predicted,
    or with keep=True all columns of docs (but for old ones of the same names)
    and these two.
    """
    docs = docs.drop("score", "predicted")
    model = fit(*labelled_sample(docs if examples is None else examples, labels, id_col, text_col, label_col, per_label), rank, neighbours, sharpness)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep else docs.select(*dict.fromkeys([id_col, text_col]))
    at = source.columns.index(text_col)
    first = source.schema if keep else docs.select(id_col).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        forget()
        for batch, texts in blocks(batches, at, 1 << 21):
            scores = []
            for i in range(0, len(texts), 256):
                scores.append(model.score(np.array([damped_counts(t) for t in texts[i : i + 256]])))
            score = np.clip(np.concatenate(scores), 0, 1)
            columns = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*first.names, "score", "predicted"])

    return source.mapInArrow(run, schema)
