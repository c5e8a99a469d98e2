"""Runs of words that repeat with a period, by the tandem-repeat method of Gusfield and Stoye (2004).

The documents of a block are one sequence of word numbers; equal words of two
documents have different numbers and each document ends with a number of its
own, so that nothing is found across documents. Names of all windows of 1, 2, 4,
... words (prefix doubling) give the order of the suffixes and, for any two
places, how far they agree to the right and to the left.

1. Lempel-Ziv blocks: every block is the longest stretch that occurs before.
   Around each block border the squares are found whose leftmost occurrence can
   only be there: a set of squares that covers the leftmost one of every kind.
2. From each of these, suffix links lead from square aw to w and, where the
   suffix tree has w followed by a, to the next square wa. Steps that stay within
   one occurrence are taken at once; where it ends, the tree (the interval of
   w in the suffix order, and in it the branch of a) tells whether another
   occurrence goes on. So the vocabulary of squares is complete.
3. Every square with a primitive half is located at all its occurrences (its
   interval in the suffix order); neighbouring ones of one period make a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, forget

#: Bytes of text that are worked off at once; a longer text is a block of its own.
BLOCK = 1 << 21


@lru_cache(maxsize=1 << 16)
def prime_factors(k: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return (*out, k) if k > 1 else tuple(out)


def _counted(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each of the counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


class Suffixes:
    """Order of the suffixes of a sequence, names of its windows of 2^l elements, and extensions of any two places.

    A name is the place in the suffix order of the first suffix that begins with
    the window. Windows over a document's end are unlike all others.
    """

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        self.order = np.argsort(x, kind="stable").astype(np.int32)
        ordered = x[self.order]
        head = np.ones(n, bool)
        head[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
        names = [rank]
        slots = np.flatnonzero(~head | ~np.append(head[1:], True))
        self.repeated = slots
        while len(slots):
            at = self.order[slots].astype(np.int64)
            key = rank[at].astype(np.int64) * n + rank[at + (1 << len(names) - 1)]
            sort = np.argsort(key, kind="stable")
            at, key = at[sort], key[sort]
            self.order[slots] = at
            head = np.ones(len(slots), bool)
            head[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
            names.append(rank)
            slots = slots[~head | ~np.append(head[1:], True)]
        self.names, self.rank = np.stack(names), rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements agree from i and j (not equal) on."""
        out = np.zeros(len(i), np.int64)
        live, steps = np.arange(len(i)), []
        for level, name in enumerate(self.names):
            live = live[name[i[live]] == name[j[live]]]
            if not len(live):
                break
            out[live] = 1 << level
            steps.append(live)
        for level in range(len(steps) - 2, -1, -1):
            some, name = steps[level + 1], self.names[level]
            same = some[name[i[some] + out[some]] == name[j[some] + out[some]]]
            out[same] += 1 << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements agree up to i and j (not equal), these included."""
        out = np.zeros(len(i), np.int64)
        live, steps = np.flatnonzero(np.minimum(i, j) >= 0), []
        for level, name in enumerate(self.names):
            back = (1 << level) - 1
            live = live[np.minimum(i[live], j[live]) >= back]
            live = live[name[i[live] - back] == name[j[live] - back]]
            if not len(live):
                break
            out[live] = 1 << level
            steps.append(live)
        for level in range(len(steps) - 2, -1, -1):
            some, name, back = steps[level + 1], self.names[level], (1 << level) - 1
            p, q = i[some] - out[some] - back, j[some] - out[some] - back
            inside = np.minimum(p, q) >= 0
            some, p, q = some[inside], p[inside], q[inside]
            out[some[name[p] == name[q]]] += 1 << level
        return out

    def interval(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the suffix order of the suffixes that begin with length elements from at: a place of the suffix tree."""
        level = np.minimum(np.frexp(length.astype(float))[1] - 1, len(self.names) - 1)
        rest = length - (1 << level)
        base = level * self.n
        flat, last = self.names.reshape(-1), self.n - 1
        name, tail = flat[base + at], flat[base + np.minimum(at + rest, last)]

        def same(slot: np.ndarray) -> np.ndarray:
            p = self.order[slot].astype(np.int64)
            return (flat[base + p] == name) & (flat[base + np.minimum(p + rest, last)] == tail)

        own = self.rank[at].astype(np.int64)
        low, high = name.astype(np.int64), own.copy()  # the first that is the same
        while (low < high).any():
            middle = (low + high) // 2
            yes = same(middle)
            high, low = np.where(yes, middle, high), np.where(yes, low, np.minimum(middle + 1, high))
        first = low
        step = np.ones(len(at), np.int64)  # gallop to the right, then halve
        low, high = own.copy(), np.full(len(at), last)
        live = np.arange(len(at))
        while len(live):
            probe = np.minimum(low[live] + step[live], last)
            p = self.order[probe].astype(np.int64)
            yes = (flat[base[live] + p] == name[live]) & (flat[base[live] + np.minimum(p + rest[live], last)] == tail[live])
            low[live[yes]] = probe[yes]
            high[live[~yes]] = probe[~yes] - 1
            step[live] *= 2
            live = live[yes & (probe < last)]
        while (low < high).any():
            middle = (low + high + 1) // 2
            yes = same(middle)
            low, high = np.where(yes, middle, low), np.where(yes, high, np.maximum(middle - 1, low))
        return first, low

    def branch(self, at: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place where length elements from at are followed by an element of the given name; -1 if there is none."""
        low, last = self.interval(at, length)
        high = last + 1
        follows = lambda slot: self.names[0][self.order[slot] + length]
        while (low < high).any():
            middle = np.minimum((low + high) // 2, last)
            less = (follows(middle) < symbol) & (low < high)
            high = np.where(less | (low >= high), high, middle)
            low = np.where(less, middle + 1, low)
        found = low <= last
        found[found] = self.names[0][self.order[low[found]] + length[found]] == symbol[found]
        return np.where(found, self.order[np.minimum(low, self.n - 1)], -1)


def block_starts(s: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest stretch that also begins at an earlier place, or one new element."""
    slots = s.repeated
    at = s.order[slots].astype(np.int64)
    m = len(at)
    # taken out from the last place to the first, each leaves its nearest earlier places in the suffix order as neighbours
    before, after = list(range(-1, m + 1)), list(range(1, m + 3))
    for r in (np.argsort(at)[::-1] + 1).tolist():
        p, q = before[r], after[r]
        after[p] = q
        before[q] = p
    longest = np.zeros(s.n, np.int64)
    for near in (before, after):
        near = np.array(near[1 : m + 1], np.int64)
        own = np.flatnonzero((near > 0) & (near <= m))
        longest[at[own]] = np.maximum(longest[at[own]], s.forward(at[own], at[near[own] - 1]))
    step, i, out = np.maximum(longest, 1).tolist(), 0, []
    while i < s.n:
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def covering_squares(s: Suffixes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares by which the leftmost square of every kind is reached; h: the blocks' starts."""
    ends = np.append(h[1:], s.n)
    size, name = ends - h, s.names[0]
    # squares whose halves meet in a block and that end in the next one
    k = _counted(size[:-1]) + 1
    right = np.repeat(ends[:-1], size[:-1])
    some = np.flatnonzero(name[right] == name[right - k])
    k, right = k[some], right[some]
    left = right - k
    k1, k2 = s.forward(right, left), s.backward(right - 1, left - 1)
    ok = k1 + k2 >= k
    starts, halves = [np.maximum(left - k2, left - k + 1)[ok]], [k[ok]]
    # squares that begin before the block, with halves that meet in it
    reach = np.minimum(size + np.append(size[1:], 0), s.n - 1 - h)
    reach[0] = 0
    k = _counted(reach) + 1
    left, stop = np.repeat(h, reach), np.repeat(ends, reach)
    some = np.flatnonzero(name[left] == name[left + k])
    some = some[name[left[some] - 1] == name[left[some] + k[some] - 1]]
    k, left, stop = k[some], left[some], stop[some]
    k1, k2 = s.forward(left, left + k), s.backward(left - 1, left + k - 1)
    start = np.maximum(left - k2, left - k + 1)
    ok = (k1 + k2 >= k) & (start + k <= stop)
    return np.concatenate([*starts, start[ok]]), np.concatenate([*halves, k[ok]])


def _stretch(s: Suffixes, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Rows (first place, half, end) of all that has the square's period around it, each once."""
    first = start - s.backward(start - 1, start + half - 1)
    end = start + half + s.forward(start, start + half)
    return np.unique(np.stack([first, half, end], axis=1), axis=0)


def vocabulary(s: Suffixes, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Rows (first place, half, end): stretches among whose squares is one of every kind, by suffix-link walks from the given ones."""
    fresh = _stretch(s, start, half)
    found, seen = [fresh], set(map(tuple, fresh[:, :2].tolist()))
    while len(fresh):
        k, end = fresh[:, 1], fresh[:, 2]
        # the last square of a stretch is aw; is w followed by a somewhere?
        other = s.branch(end - 2 * k + 1, 2 * k - 1, s.names[0][end - 2 * k].astype(np.int64))
        there = other >= 0
        fresh = _stretch(s, other[there].astype(np.int64), k[there]) if there.any() else fresh[:0]
        new = [row not in seen for row in map(tuple, fresh[:, :2].tolist())]
        fresh = fresh[np.array(new, bool)]
        seen.update(map(tuple, fresh[:, :2].tolist()))
        found.append(fresh)
    return np.concatenate(found)


def runs_of(x: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all maximal repetitions of at least two periods, the smallest period of each, by period and start.

    x: numbers of the elements, in which each document ends with one that occurs once.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(x):
        return none
    s = Suffixes(x)
    if not len(s.repeated):
        return none
    start, half = covering_squares(s, block_starts(s))
    if not len(start):
        return none
    kinds = vocabulary(s, start, half)
    first, k, end = kinds.T
    # a stretch whose period is a multiple of a smaller one is found with that one
    row, shorter = zip(*((i, q // p) for i, q in enumerate(k.tolist()) for p in prime_factors(q))) if (k > 1).any() else ((), ())
    row, shorter = np.array(row, np.int64), np.array(shorter, np.int64)
    if len(row):
        again = s.forward(first[row], first[row] + shorter) >= end[row] - first[row] - shorter
        keep = np.ones(len(k), bool)
        keep[row[again]] = False
        first, k, end = first[keep], k[keep], end[keep]
    many = np.minimum(end - 2 * k - first + 1, k)
    at, k = np.repeat(first, many) + _counted(many), np.repeat(k, many)
    low, high = s.interval(at, 2 * k)
    kind = np.unique(np.stack([k, low, high], axis=1), axis=0)
    k, low, many = kind[:, 0], kind[:, 1], kind[:, 2] - kind[:, 1] + 1
    place = np.sort(np.repeat(k, many) * s.n + s.order[np.repeat(low, many) + _counted(many)])
    begins = np.ones(len(place), bool)
    begins[1:] = place[1:] != place[:-1] + 1
    edges = np.flatnonzero(begins)
    period, start = place[edges] // s.n, place[edges] % s.n
    last = place[np.append(edges[1:], len(place)) - 1] % s.n
    return np.stack([start, last + 2 * period - start, period], axis=1)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each text's own and with an end of its own, and where each text begins (and the last ends)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    x = np.empty(starts[-1], np.int64)
    known: dict[bytes, int] = {}
    number = known.setdefault
    for k, words in enumerate(texts):
        x[starts[k] : starts[k + 1] - 1] = [number(w, len(known)) for w in words]
        x[starts[k + 1] - 1] = 0
    x += np.repeat(np.arange(len(texts)) * (len(known) + 1), np.diff(starts))
    x[starts[1:] - 1] = (len(texts) + 1) * (len(known) + 1) + np.arange(len(texts))
    return x, starts


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """id_col, n_words, runs and collapsed of every row.

    Words are what the characters U+0009 to U+000D and the blank part, numbered
    from 0. runs: array of (start, length, period), by start, then period: all
    stretches of at least min_length words and two periods that no neighbouring
    word extends. collapsed: the words joined by one blank, without those that
    a run holds after its first period. Null and empty texts have no words and
    an empty collapsed; a very long text is worked off by itself (about 4 bytes a
    word for each doubling of its longest repeat, and 200 more). Rows with equal
    ids or texts each give a row, other columns are not used, a null id stays null, no rows give no
    rows. There is no shuffle.
    """
    source = docs.select(id_col, text_col)
    key = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, texts in blocks(batches, 1, BLOCK):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            x, starts = numbered(words)
            runs = runs_of(x)
            runs = runs[runs[:, 1] >= min_length]
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            doc = np.searchsorted(starts, runs[:, 0], "right") - 1
            depth = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(x) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(x) + 1)
            kept = (np.cumsum(depth) == 0).tolist()
            own = np.bincount(doc, minlength=len(words))
            collapsed = [
                b" ".join(compress(w, kept[a : a + len(w)]) if some else w).decode("utf-8", "surrogatepass") for w, a, some in zip(words, starts.tolist(), own.tolist())
            ]
            fields = [pa.array(v) for v in (runs[:, 0] - starts[doc], runs[:, 1], runs[:, 2])]
            offsets = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            n_words = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, listed, pa.array(collapsed, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, f"`{id_col}` {key}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col, in which the texts of a tenth of the ids repeat a stretch of their words.

    With h = crc32 of the id in decimals and g = floor(h / 10): where h % 10 = 0
    and the text has n > 0 words, each word i >= a becomes word a + (i - a) % p,
    for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other rows, also those of null id or text, stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), "[ \t-\r]+"), lambda w: w != "")
    made = F.struct(words.alias("w"), F.expr("g").alias("g"))

    def sized(s):
        n = F.size(s["w"]).cast("long")
        return F.struct(s["w"].alias("w"), n.alias("n"), (s["g"] % n).alias("a"), F.floor((n - s["g"] % n) / (3 + s["g"] % 8)).alias("p"))

    def spelled(s):
        places = F.sequence(F.lit(0).cast("long"), s["n"] - 1)
        word = lambda i: F.get(s["w"], F.when(i >= s["a"], s["a"] + (i - s["a"]) % (s["p"] + 1)).otherwise(i).cast("int"))
        return F.when(s["n"] > 0, F.array_join(F.transform(places, word), " ")).otherwise("")

    # transform over an array of one: the words are split once
    planted = F.element_at(F.transform(F.transform(F.array(made), sized), spelled), 1)
    return (
        docs.select(F.col(id_col), F.col(text_col), h.alias("h"), F.floor(h / 10).alias("g"))
        .withColumn(text_col, F.when((F.col("h") % 10 == 0) & F.col(text_col).isNotNull(), planted).otherwise(F.col(text_col)))
        .select(id_col, text_col)
    )


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_runs, the longest run's start, length, period and exponent_milli, and SHA-256 of all runs and of the collapsed text."""
    # ties go to the smallest start, then period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("b", longest)
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
