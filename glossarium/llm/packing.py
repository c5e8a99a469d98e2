"""Best-fit packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most one row per length up to the
capacity) comes to the driver. There the configuration LP - how often to use
each way of filling a sequence, so that every piece is placed - is solved by
multiplicative weights: lengths have prices (the dual), a knapsack table prices
every filling at once, fillings are used for a share of the demand, and the
prices of lengths ahead of their share fall. Any prices, divided by the dearest
filling's, are a feasible dual, so each table also certifies a lower bound. The
solution is rounded: whole uses first, then what is left of them by a running
sum over fillings in order; the LP of what is still to be placed is solved
anew, until nothing is left or this gains no more. Best fit places the residue.
Tasks then place every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks, kept, word_encoder
from .common import materialise

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def price_fillings(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value for each room up to capacity, and the length placed last (-1: none, one less room)."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = np.full(capacity + 1, -1.0)
    worth[lengths] = prices[lengths]
    for room in range(1, capacity + 1):
        got = value[room - 1 :: -1] + worth[1 : room + 1]
        best = int(got.argmax())
        if got[best] > value[room - 1]:
            value[room], last[room] = got[best], best + 1
        else:
            value[room], last[room] = value[room - 1], -1
    return value, last


def trace(last: np.ndarray, room: int, demand: np.ndarray, seed: int) -> Filling:
    """The filling that the table chose beside one piece of length seed; no length more often than demanded."""
    out = {seed: 1}
    while room > 0:
        length = int(last[room])
        if length > 0 and out.get(length, 0) < demand[length]:
            out[length] = out.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(out.items(), reverse=True))


@dataclass(frozen=True)
class Solution:
    """uses: how often each filling is used; value: their sum; bound: no packing, whole or not, has fewer."""

    uses: dict[Filling, float]
    value: float
    bound: float


def solve_lp(demand: np.ndarray, capacity: int) -> Solution:
    """The best of solutions from several prices to begin with, until its value can mean no sequence more than the bound.

    Prices as long as the pieces suit demands with many short ones; with mostly
    long pieces those should be worth more than their share.
    """
    lengths = np.flatnonzero(demand)
    volume = np.arange(capacity + 1) / capacity
    bound = float((demand * volume).sum() / price_fillings(volume, lengths, capacity)[0][capacity])
    best = None
    for power, rounds in ((1.0, 6), (1.1, 6), (1.3, 6), (1.3, 24)):
        found = multiplicative_weights(demand, capacity, volume**power, rounds)
        bound = max(bound, found.bound)
        best = found if best is None or found.value < best.value else best
        if best.value <= ceil(bound - 1e-6):
            break
    return Solution(best.uses, best.value, bound)


def multiplicative_weights(demand: np.ndarray, capacity: int, prices: np.ndarray, rounds: int, eta: float = 0.05) -> Solution:
    """Fractional uses of fillings that place all of the demand by length.

    In each round every length still to be placed seeds a filling, which is used
    for the round's share of it, as far as the others in it last. From the last
    planned round on the share is all, so that each filling uses up a length and
    the rounds end.
    """
    todo, prices = demand.astype(float), prices.copy()
    uses: dict[Filling, float] = defaultdict(float)
    bound, t = 0.0, 0
    while len(lengths := np.flatnonzero(todo > 1e-9)):
        value, last = price_fillings(prices, lengths, capacity)
        bound = max(bound, float((demand * prices)[lengths].sum() / value[capacity]))
        share, start, used = 1 / max(1, rounds - t), todo.copy(), np.zeros(capacity + 1)
        for seed in lengths[::-1].tolist():
            if todo[seed] <= 1e-9:
                continue
            filling = trace(last, capacity - seed, demand, seed)
            amount = min(todo[x] / n for x, n in filling)
            amount = min(amount, start[seed] * share / dict(filling)[seed])
            if amount > 1e-9:
                uses[filling] += amount
                for x, n in filling:
                    todo[x] -= amount * n
                    used[x] += amount * n
        prices[lengths] *= np.exp(-eta * (used[lengths] / start[lengths] - share))
        t += 1
    return Solution(dict(uses), sum(uses.values()), bound)


def round_uses(uses: dict[Filling, float], demand: np.ndarray) -> tuple[Counter, np.ndarray]:
    """Whole uses of fillings within the demand, one at least, and what of it is left."""
    out, left, parts = Counter(), demand.copy(), []

    def use(filling: Filling, wanted: int) -> int:
        times = min(wanted, *(int(left[x]) // n for x, n in filling))
        if times > 0:
            out[filling] += times
            for x, n in filling:
                left[x] -= times * n
        return max(0, times)

    for filling, amount in uses.items():
        parts.append((filling, amount - use(filling, int(amount + 1e-9))))
    total = 0.0
    for filling, part in sorted(parts, reverse=True):
        total += part
        if total >= 1:
            # a filling that is no longer possible leaves its turn to the next
            total -= use(filling, 1)
    if not out:
        use(max(uses, key=uses.get), 1)
    return out, left


def best_fit(todo: np.ndarray, capacity: int) -> Counter:
    """Fillings for the pieces left: longest first, each into the sequence with the least room that is enough; equal sequences are filled together."""
    free: dict[int, Counter] = defaultdict(Counter)  # by room: what is in the sequences, and how many there are
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(todo)[::-1].tolist():
        n = int(todo[length])
        while n:
            fit = np.flatnonzero(rooms[length:])
            room = length + int(fit[0]) if len(fit) else capacity
            if len(fit):
                items, there = free[room].popitem()
                rooms[room] = bool(free[room])
            else:
                items, there = (), n
            each = min(room // length, n)
            used = min(there, n // each)
            n -= used * each
            if there > used and len(fit):
                free[room][items] += there - used
                rooms[room] = True
            free[room - each * length][*items, (length, each)] += used
            rooms[room - each * length] = True
    out: Counter = Counter()
    for fillings in free.values():
        for items, times in fillings.items():
            whole: Counter = Counter()
            for length, n in items:
                whole[length] += n
            out[tuple(sorted(whole.items(), reverse=True))] += times
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Filling, int]], dict[str, float]]:
    """Fillings and how often each is used, so that every piece of the histogram has its place; and figures of the way there.

    Of the passes of LP and rounding the result is the last that, with best fit
    for what it left, needs fewest sequences; a worse pass ends the search. If
    that is not certified to be least, best fit for all is tried, too.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    placed: Counter = Counter()
    if full := int(demand[capacity]):
        placed[(capacity, 1),] = full
        demand[capacity] = 0
    figures = {"lp": float(full), "bound": float(full), "residue": 0}
    best, left, passes, alone = placed, demand, 0, placed
    while left.any():
        found = solve_lp(left, capacity)
        if not passes:
            figures |= {"lp": full + found.value, "bound": full + found.bound}
        whole, left = round_uses(found.uses, left)
        placed = placed + whole
        now = placed + best_fit(left, capacity)
        passes += 1
        if passes > 1 and now.total() > best.total():
            break
        best, figures["residue"] = now, int(left.sum())
    if best.total() > ceil(figures["bound"] - 1e-6):
        fit = alone + best_fit(demand, capacity)
        if fit.total() < best.total():
            best, figures["residue"] = fit, int(demand.sum())
    return sorted(best.items(), reverse=True), figures | {"bins": best.total(), "passes": passes}


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ids: bool = False
) -> DataFrame:
    """Pieces of at most capacity tokens of every row: id_col, piece, start, length, ids_crc32 (and ids with ids=True).

    A document is its ids and then end_id, so a null or empty text is one piece
    of length one. Only documents longer than capacity are cut, and all their
    pieces but the last are full. Repeated rows give pieces of their own.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(id_col, text_col)
    key = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept((tokenizer_path, "words"), lambda: word_encoder(shared.value))
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch, texts in blocks(batches, 1, 1 << 23):
            row, piece, start, length, crc, packed = [], [], [], [], [], []
            for i, own in enumerate(encoder.encode(texts)):
                own += end
                for k, at in enumerate(range(0, len(own), width)):
                    part = own[at : at + width]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if ids:
                        packed.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(packed, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", salts: int = 64) -> DataFrame:
    """pieces (with piece and length) and their sequence_id and offset; offsets are gapless from 0 in every sequence.

    pieces is read several times and should be a written table. Pieces of one
    length are ranked within salts and the salts' counts are summed, so that a
    length which a third of all pieces have is not ordered by one task. What is
    collected and broadcast is bounded by capacity and salts alone. Ties (equal
    id, piece and length) are in any order. No pieces: no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, base = [], 0
    for filling, times in plan(histogram, capacity)[0]:
        offset = 0
        for length, n in filling:
            entries.append((length, n, offset, base, times))
            offset += length * n
        base += times
    entries.sort(key=lambda e: e[0])
    length, per, offset, first, times = np.array(entries, np.int64).reshape(-1, 5).T
    ranks = np.concatenate([[0], np.cumsum(per * times)[:-1]]) if len(per) else np.zeros(0, np.int64)
    starts = np.searchsorted(length, length)  # ranks begin anew for each length
    ranks = ranks - ranks[starts] if len(per) else ranks
    shared = pieces.sparkSession.sparkContext.broadcast((length << 40 | ranks, ranks, per, offset, first))

    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy("length", "__salt")
        .agg(F.count("*").alias("__n"))
        .select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy("length", "__salt").orderBy(id_col, "piece")
    ranked = (
        salted.join(F.broadcast(offsets), ["length", "__salt"])
        .withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)
        .select(*pieces.columns, F.col("__rank").cast("long").alias("__rank"))
    )
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id bigint, offset bigint"])
    names = [*pieces.columns, "sequence_id", "offset"]
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, per, offset, first = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            entry = np.searchsorted(keys, own << 40 | rank, side="right") - 1
            within = rank - ranks[entry]
            sequence = first[entry] + within // per[entry]
            place = offset[entry] + within % per[entry] * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(place)], names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place: see tokenised_pieces and place.

    The pieces (a few numbers each, no ids) are written to the shared folder
    once, so texts are tokenised once whatever fails later.
    """
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, capacity, id_col, text_col, end_id), "pieces")
    return place(pieces, capacity, id_col)
