"""Distances between two segment arrays, as native column expressions.

Every function takes two array columns; normalised ones lie between 0 and 1 for
arrays that are not empty. Dynamic programmes are folds over one array with the
row of the matrix as the state, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import ngrams

Cell = Callable[[Column, Column, Column, Column, Column, Column, Column], Column]


def fold_matrix(a: Column, b: Column, first: Callable[[Column], Column], cell: Cell) -> Column:
    """The last row of a matrix over a (rows) and b (columns).

    first: the value of the border at a distance from the corner. cell: (left,
    above, corner, x, y, i, j) to the value, x and y the elements at i and j
    (from 1).
    """
    n = F.size(b)
    top = F.transform(F.sequence(F.lit(0), n), lambda j: first(j).cast("double"))

    def next_row(state: Column, pair: Column) -> Column:
        def next_cell(row: Column, j: Column) -> Column:
            value = cell(
                F.element_at(row, -1), F.get(state, j), F.get(state, j - 1), pair["x"], F.get(b, j - 1), pair["i"], j
            )
            return F.concat(row, F.array(value.cast("double")))

        columns = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, F.array(first(pair["i"]).cast("double")), next_cell)

    rows = F.transform(a, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("i")))
    return F.aggregate(rows, top, next_row)


def _last(row: Column) -> Column:
    return F.element_at(row, -1)


def edit_distance(a: Column, b: Column, cost: Callable[[Column, Column], Column] | None = None) -> Column:
    """Insertions and deletions of cost 1, substitutions of cost 1 or cost(x, y)."""
    change = cost or (lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    cell = lambda left, above, corner, x, y, i, j: F.least(left + 1, above + 1, corner + change(x, y))
    return _last(fold_matrix(a, b, lambda k: k, cell))


def longest_common_subsequence(a: Column, b: Column) -> Column:
    cell = lambda left, above, corner, x, y, i, j: F.greatest(left, above, corner + (x == y).cast("int"))
    return _last(fold_matrix(a, b, lambda k: F.lit(0), cell))


def needleman_wunsch(a: Column, b: Column, match: float = 1, mismatch: float = -1, gap: float = -1) -> Column:
    """Score of the best global alignment."""
    score = lambda x, y: F.when(x == y, float(match)).otherwise(float(mismatch))
    cell = lambda left, above, corner, x, y, i, j: F.greatest(left + gap, above + gap, corner + score(x, y))
    return _last(fold_matrix(a, b, lambda k: k * gap, cell))


def _longer(a: Column, b: Column) -> Column:
    return F.greatest(F.size(a), F.size(b))


def _share(value: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(value / whole)


def ldn(a: Column, b: Column, normalized: bool = True) -> Column:
    d = edit_distance(a, b)
    return _share(d, _longer(a, b)) if normalized else d


def ldn_swap(a: Column, b: Column, normalized: bool = True) -> Column:
    """Edit distance in which two neighbours that change places cost 1 (each substring changed once)."""
    n = F.size(b)
    zero = F.transform(F.sequence(F.lit(0), n), lambda j: j.cast("double"))
    start = F.struct(zero.alias("now"), zero.alias("past"), F.lit(None).cast("string").alias("x"))

    def next_row(state: Column, pair: Column) -> Column:
        def next_cell(row: Column, j: Column) -> Column:
            y, before = F.get(b, j - 1), F.get(b, j - 2)
            plain = F.least(F.element_at(row, -1) + 1, F.get(state["now"], j) + 1, F.get(state["now"], j - 1) + F.when(pair["x"] == y, 0).otherwise(1))
            swapped = (pair["i"] > 1) & (j > 1) & (pair["x"] == before) & (state["x"] == y)
            value = F.when(swapped, F.least(plain, F.get(state["past"], F.greatest(j - 2, F.lit(0))) + 1)).otherwise(plain)
            return F.concat(row, F.array(value.cast("double")))

        columns = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        row = F.aggregate(columns, F.array(pair["i"].cast("double")), next_cell)
        return F.struct(row.alias("now"), state["now"].alias("past"), pair["x"].alias("x"))

    rows = F.transform(a, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("i")))
    d = F.aggregate(rows, start, next_row, lambda s: F.element_at(s["now"], -1))
    return _share(d, _longer(a, b)) if normalized else d


def lcs(a: Column, b: Column, normalized: bool = True) -> Column:
    """1 - longest common subsequence / longer (or longer - subsequence)."""
    s, longer = longest_common_subsequence(a, b), _longer(a, b)
    return 1 - _share(s, longer) if normalized else longer - s


def _common(x: Column, y: Column, order: int, version: str) -> Column:
    """How much two n-grams have in common, from 0 to 1: equal or not (binary), elements of x that y has anywhere (comprehensive), places at which they agree (positional)."""
    if version == "binary":
        return (x == y).cast("double")
    if version == "comprehensive":
        return F.size(F.filter(x, lambda e: F.array_contains(y, e))) / F.lit(float(order))
    return sum(((F.get(x, k) == F.get(y, k)).cast("double") for k in range(order)), F.lit(0.0)) / order


def gram_distance(a: Column, b: Column, order: int, version: str = "binary", normalized: bool = True) -> Column:
    """Edit distance over the n-grams of two sequences padded with '-', a substitution by what two n-grams do not share.

    The binary version takes all n-grams, the others leave out the last one of
    each sequence.
    """
    x, y = (ngrams(s, order, "-") for s in (a, b))
    if version != "binary":
        x, y = (F.slice(s, 1, F.size(s) - 1) for s in (x, y))
    d = edit_distance(x, y, lambda p, q: 1 - _common(p, q, order, version))
    return _share(d, F.greatest(F.size(x), F.size(y))) if normalized else d


def gram_similarity(a: Column, b: Column, order: int, version: str = "binary", normalized: bool = True) -> Column:
    """Best alignment of the n-grams that begin at or before an element of their own, by what they share, taken from the longer sequence (Kondrak, 2005)."""
    x, y = (F.slice(ngrams(s, order, "-"), 1, F.size(s)) for s in (a, b))
    cell = lambda left, above, corner, p, q, i, j: F.greatest(left, above, corner + _common(p, q, order, version))
    s, longer = _last(fold_matrix(x, y, lambda k: F.lit(0), cell)), _longer(a, b)
    return 1 - _share(s, longer) if normalized else longer - s


def jcdn(a: Column, b: Column, normalized: bool = True) -> Column:
    """Jaccard distance over n-grams up to three, padded with '-'.

    The grams of b are those at the place where the last ones of a begin, as
    often as b has places; totals are those of neighbours without pads. So
    results are what users of this measure know, not a metric.
    """
    pads = F.array(*[F.lit("-")] * 2)
    x, y = F.concat(pads, a, pads), F.concat(pads, b, pads)
    gram = lambda s, i, k: F.array_join(F.slice(s, i, k), ",")
    own = F.flatten(F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.array(*[gram(x, i, F.lit(k)) for k in (1, 2, 3)])))
    other = F.flatten(F.array_repeat(F.array(*[gram(y, F.size(x) - 1, F.lit(k)) for k in (1, 2, 3)]), F.size(y) - 1))
    common = overlap(own, other)
    total = F.size(a) + F.size(b) - 2 - common
    value = 1 - common / total if normalized else (total - common).cast("double")
    return F.when(total == 0, 0.0).otherwise(value)


def _pairs(array: Column, skip: int = 1) -> Column:
    n = F.size(array) - skip
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(",", F.get(array, i - 1), F.get(array, i - 1 + skip)))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(some)


def _triples(array: Column) -> Column:
    return F.transform(ngrams(array, 3, None), lambda g: F.array_join(g, ","))


def overlap(x: Column, y: Column) -> Column:
    """Elements that two arrays have in common, repeats counted as often as in both."""
    times = lambda array, g: F.size(F.filter(array, lambda e: e == g))
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(times(x, g), times(y, g)))


def _dice(x: Column, y: Column, common: Column, normalized: bool, empty: Column | float) -> Column:
    total = F.size(x) + F.size(y)
    short = (F.size(x) < 1) | (F.size(y) < 1)
    value = 1 - 2 * common / total if normalized else total - 2 * common
    return F.when((total == 0) if empty is None else short, F.lit(0.0 if empty is None else empty)).otherwise(value.cast("double"))


def dice(a: Column, b: Column, normalized: bool = True) -> Column:
    """Over neighbours; 0 if neither sequence has two elements."""
    x, y = _pairs(a), _pairs(b)
    return _dice(x, y, overlap(x, y), normalized, None)


def xdice(a: Column, b: Column, normalized: bool = True) -> Column:
    """Over elements with one between them; 0 if a sequence is too short."""
    x, y = _pairs(a, 2), _pairs(b, 2)
    return _dice(x, y, overlap(x, y), normalized, 0.0)


def trigram(a: Column, b: Column, normalized: bool = True) -> Column:
    """Over three neighbours; 1 if a sequence is too short."""
    x, y = _triples(a), _triples(b)
    return _dice(x, y, overlap(x, y), normalized, 1.0)


def xxdice(a: Column, b: Column, normalized: bool = True) -> Column:
    """Over neighbours, each meeting of equal ones weighted by 1 / (1 + squared distance of the places)."""
    x, y = _pairs(a), _pairs(b)
    meets = F.transform(
        x,
        lambda g, i: F.aggregate(
            F.transform(y, lambda h, j: F.when(g == h, 1.0 / (1 + F.pow(i - j, F.lit(2)))).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v
        ),
    )
    return _dice(x, y, F.aggregate(meets, F.lit(0.0), lambda acc, v: acc + v), normalized, None)


def jcd(a: Column, b: Column, normalized: bool = True) -> Column:
    """Jaccard distance over neighbours, repeats counted."""
    x, y = _pairs(a), _pairs(b)
    common = overlap(x, y)
    total = F.size(x) + F.size(y) - common
    value = 1 - common / total if normalized else (total - common).cast("double")
    return F.when(total == 0, 0.0).otherwise(value)


def prefix(a: Column, b: Column, normalized: bool = True) -> Column:
    """Share of the longer sequence's places at which both have the same element, taken from 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    return 1 - _share(same, _longer(a, b)) if normalized else (_longer(a, b) - same).cast("double")


def ident(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def percent_identity(a: Column, b: Column, mode: int = 2) -> Column:
    """Identity of two aligned sequences of equal length ('-' is a gap).

    Equal elements over: 1 the columns without gaps, 2 those and the gaps
    inside, 3 the shorter sequence's elements, 4 the shorter's span between
    its first and last element, 5 all columns.
    """
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    full = F.size(F.filter(both, lambda p: (p["x"] != "-") & (p["y"] != "-")))
    same = F.size(F.filter(both, lambda p: (p["x"] == p["y"]) & (p["x"] != "-")))
    gaps = F.size(F.filter(both, lambda p: (p["x"] == "-") | (p["y"] == "-")))
    solid = lambda s: F.size(F.filter(s, lambda x: x != "-"))
    marks = lambda s: F.regexp_replace(F.array_join(F.transform(s, lambda x: F.when(x == "-", "-").otherwise("x")), ""), "^-+|-+$", "")
    whole = {1: full, 2: full + gaps, 3: F.least(solid(a), solid(b)), 4: F.least(F.length(marks(a)), F.length(marks(b))), 5: F.size(a)}[mode]
    return _share(same, whole)


#: All distances by name, for pair queries.
METRICS: dict[str, Callable[..., Column]] = {
    "ldn": ldn,
    "ldn_swap": ldn_swap,
    "lcs": lcs,
    "dice": dice,
    "jcd": jcd,
    "prefix": prefix,
    "xdice": xdice,
    "trigram": trigram,
    "xxdice": xxdice,
    "jcdn": jcdn,
    **{
        f"{prefix}{kind}{k}": partial(function, order=order, version=version)
        for order, prefix in ((2, "bi"), (3, "tri"))
        for kind, function in (("dist", gram_distance), ("sim", gram_similarity))
        for k, version in enumerate(("binary", "comprehensive", "positional"), 1)
    },
}
