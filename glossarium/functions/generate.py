"""Random words from bigram models: seeded walks over counts of transitions."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from math import log10

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "#", "$"


def transitions(words: DataFrame, segments: str) -> DataFrame:
    """prev, next and n over all words, with marks for their start and end."""
    padded = F.concat(F.array(F.lit(START)), F.col(segments), F.array(F.lit(END)))
    pairs = F.transform(F.sequence(F.lit(1), F.size(padded) - 1), lambda i: F.struct(F.get(padded, i - 1).alias("prev"), F.get(padded, i).alias("next")))
    return words.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.next").agg(F.count("*").alias("n"))


class Walker:
    """Walks over a table of transitions, whose size is that of the alphabet squared."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.next: dict[str, tuple[list[str], list[int]]] = {}
        for prev, following, n in sorted(counts):
            names, weights = self.next.setdefault(prev, ([], []))
            names.append(following)
            weights.append(n)

    def walk(self, rng: random.Random, longest: int = 100) -> list[str]:
        out, at = [], START
        while len(out) < longest:
            at = rng.choices(*self.next[at])[0]
            if at == END:
                break
            out.append(at)
        return out

    def score(self, word: list[str]) -> float:
        """log10 of the word's probability; minus infinity if a transition is new."""
        total, at = 0.0, START
        for x in [*word, END]:
            names, weights = self.next.get(at, ([], []))
            if x not in names:
                return float("-inf")
            total += log10(weights[names.index(x)] / sum(weights))
            at = x
        return total


def random_words(words: DataFrame, segments: str, k: int, seed: int, new: bool = True) -> DataFrame:
    """n (from 0) and word of k walks; with new, walks that are words already are drawn anew (up to 100 times)."""
    counts = [tuple(r) for r in transitions(words, segments).collect()]
    spark = words.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(counts)
        for batch in batches:
            rows = [(int(n), t, "".join(walker.walk(random.Random(f"{seed}/{n}/{t}")))) for n in batch.id for t in range(100 if new else 1)]
            yield pd.DataFrame(rows, columns=["n", "attempt", "word"])

    drawn = spark.range(k).mapInPandas(run, "n bigint, attempt int, word string")
    if new:
        drawn = drawn.join(words.select(F.array_join(segments, "").alias("word")).distinct(), "word", "left_anti")
    return drawn.groupBy("n").agg(F.min_by("word", "attempt").alias("word"))


def label_sets(n: int) -> Iterator[list[int]]:
    """All ways of putting n elements into clusters, as labels from 1 by first place."""

    def further(labels: list[int]) -> Iterator[list[int]]:
        if len(labels) == n:
            yield labels
            return
        for x in range(1, max(labels, default=0) + 2):
            yield from further([*labels, x])

    yield from further([])


def random_labels(n: int, rng: random.Random, bias: str = "") -> list[int]:
    """Random clusters of n elements; bias lumper or splitter draws large or small ones."""
    out: list[int] = []
    for _ in range(n):
        top = max(out, default=0)
        new = rng.random() < {"lumper": 0.1, "splitter": 0.9}.get(bias, 0.5)
        out.append(top + 1 if new or not out else rng.choice(out))
    return out
