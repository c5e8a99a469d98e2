"""N-grams of segment arrays as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD, STATE = "$$$", "###"


def segments(text: Column) -> Column:
    """A form as an array: split at blanks if it has any, else into characters."""
    return F.when(text.contains(" "), F.split(F.trim(text), r"\s+")).otherwise(F.filter(F.split(text, ""), lambda x: x != ""))


def bound(array: Column, use: Callable[[Column], Column]) -> Column:
    """use(array), with the array computed once, however often use and its lambdas ask for it."""
    return F.element_at(F.transform(F.array(array), use), 1)


def _windows(array: Column, size: int) -> Column:
    """All runs of size neighbours; none if the array is shorter."""

    def runs(whole: Column) -> Column:
        last = F.size(whole) - size + 1
        return F.when(last < 1, F.array().cast("array<array<string>>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(whole, i, size))
        )

    return bound(array, runs)


def ngrams(array: Column, order: int, pad: str | None = PAD) -> Column:
    """N-grams of an order, with order - 1 pads on both sides (none with pad=None); order 0 has none."""
    if order < 1:
        return F.array().cast("array<array<string>>")
    if pad is not None and order > 1:
        side = F.array(*[F.lit(pad)] * (order - 1))
        array = F.concat(side, array, side)
    return _windows(array, order)


def bigrams(array: Column, pad: str | None = PAD) -> Column:
    return ngrams(array, 2, pad)


def trigrams(array: Column, pad: str | None = PAD) -> Column:
    return ngrams(array, 3, pad)


def fourgrams(array: Column, pad: str | None = PAD) -> Column:
    return ngrams(array, 4, pad)


def ngrams_by_order(array: Column, orders: list[int], pad: str | None = PAD) -> Column:
    """The n-grams of several orders, one after the other."""
    return F.concat(*[ngrams(array, n, pad) for n in orders])


def skipngrams(array: Column, order: int, max_gap: int, pad: str | None = PAD) -> Column:
    """N-grams with one gap of 0 to max_gap elements anywhere between two neighbours (gap 0 once)."""
    if order < 2:
        raise ValueError("skip n-grams need an order of 2 or more")
    if pad is not None:
        side = F.array(*[F.lit(pad)] * (order - 1))
        array = F.concat(side, array, side)
    parts = [_windows(array, order)]
    for gap in range(1, max_gap + 1):
        for left in range(1, order):
            whole = _windows(array, order + gap)
            parts.append(F.transform(whole, _without(left, gap, order)))
    return F.concat(*parts)


def _without(left: int, gap: int, order: int):
    return lambda w: F.concat(F.slice(w, 1, left), F.slice(w, left + gap + 1, order - left))


def posngrams(array: Column, pre: int = 0, post: int = 0, pad: str = PAD, state: str = STATE) -> Column:
    """(context, state, index) for each segment: its neighbours, the state's mark at its own place, the segment, its place from 0."""
    before = F.array(*[F.lit(pad)] * pre).cast("array<string>")
    after = F.array(*[F.lit(pad)] * post).cast("array<string>")

    def found(padded: Column) -> Column:
        def at(i: Column) -> Column:
            left = F.slice(padded, i + 1, pre) if pre else before
            right = F.slice(padded, i + pre + 2, post) if post else after
            return F.struct(F.concat(left, F.array(F.lit(state)), right).alias("context"), F.get(padded, i + pre).alias("state"), i.cast("int").alias("index"))

        n = F.size(padded) - pre - post
        places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, at)

    return bound(F.concat(before, array, after), found)


def inner_ngrams(array: Column) -> Column:
    """Every run of neighbours that trimming both ends or one end of a sequence gives, as blank-joined strings, longest first, then by place."""
    n = F.size(array)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(array, i, n - k + 1), " ")),
    )
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.flatten(runs))


def count_ngrams(df: DataFrame, array: Column, order: int) -> DataFrame:
    """ngram (blank-joined) and how often it occurs; counted before the shuffle."""
    return df.select(F.explode(ngrams(array, order)).alias("g")).groupBy(F.array_join("g", " ").alias("ngram")).agg(F.count("*").alias("n"))


def context_counts(df: DataFrame, array: Column, pre: int, post: int) -> DataFrame:
    """context (blank-joined), state and how often they meet: the counts of an n-gram model; add those of new sequences by summing."""
    return (
        df.select(F.explode(posngrams(array, pre, post)).alias("g"))
        .groupBy(F.array_join("g.context", " ").alias("context"), F.col("g.state").alias("state"))
        .agg(F.count("*").alias("n"))
    )
