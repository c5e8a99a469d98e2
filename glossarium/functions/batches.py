"""Alignment of many pairs of sequences at once: each cell of the matrices is worked out for a whole batch of pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from .align import DIAGONAL, LEFT, UP


@dataclass
class Sequences:
    """Padded codes, gap weights and prosodic symbols (as code points; 0 where there is none) of some sequences."""

    codes: np.ndarray
    weights: np.ndarray
    prosody: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, codes: Sequence[Sequence[int]], weights: Sequence[Sequence[float]] | None = None, prosody: Sequence[str] | None = None) -> Sequences:
        lengths = np.array([len(c) for c in codes], np.int64)
        shape = (len(codes), int(lengths.max(initial=0)))
        out = cls(np.zeros(shape, np.int64), np.ones(shape), np.zeros(shape, np.int64), lengths)
        for k, own in enumerate(codes):
            out.codes[k, : len(own)] = own
            if weights is not None:
                out.weights[k, : len(own)] = weights[k]
            if prosody is not None:
                out.prosody[k, : len(own)] = [ord(c) for c in prosody[k]]
        return out

    def take(self, rows: np.ndarray) -> Sequences:
        width = int(self.lengths[rows].max(initial=0))
        return Sequences(self.codes[rows, :width], self.weights[rows, :width], self.prosody[rows, :width], self.lengths[rows])


def with_prosody(scores: np.ndarray, a: Sequences, b: Sequences, factor: float, restricted: str, strict: bool) -> np.ndarray:
    """Scores (pairs x a x b) raised by factor where prosodic symbols are equal, by half of it where they are near; restricted symbols only meet each other."""
    apart = np.abs(a.prosody[:, :, None] - b.prosody[:, None, :])
    near = apart >= 2 if strict else apart <= 2
    scores = scores * (1 + np.where(apart == 0, factor, np.where(near, factor / 2, 0.0)))
    kept_apart = [np.isin(x.prosody, [ord(c) for c in restricted]) for x in (a, b)]
    return np.where(kept_apart[0][:, :, None] != kept_apart[1][:, None, :], -1e6, scores)


def align_all(scores: np.ndarray, a: np.ndarray, b: np.ndarray, gap_a: np.ndarray, gap_b: np.ndarray, mode: str, scale: float) -> tuple[np.ndarray, Callable[[], tuple[np.ndarray, np.ndarray]]]:
    """Scores of the best alignments of all pairs, and a function for their columns.

    scores: pairs x n x m; a and b: lengths; gap_a, gap_b: costs of gaps. The
    columns are places in a and in b from the last one to the first, -1 for a
    gap, -2 in both after the end. Modes global, overlap and local, and ties, as
    in align.align.
    """
    size, n, m = scores.shape
    value, trace = np.zeros((n + 1, m + 1, size)), np.zeros((n + 1, m + 1, size), np.int8)
    trace[1:, 0], trace[0, 1:] = LEFT, UP
    if mode == "global":
        value[1:, 0] = np.cumsum(gap_a.T * scale, axis=0)
        value[0, 1:] = np.cumsum(gap_b.T * scale, axis=0)
    best, end_i, end_j = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for j in range(1, m + 1):
        for i in range(1, n + 1):
            up = gap_b[:, j - 1] * np.where(trace[i, j - 1] == UP, scale, 1.0)
            left = gap_a[:, i - 1] * np.where(trace[i - 1, j] == LEFT, scale, 1.0)
            if mode == "overlap":
                up, left = np.where(a == i, 0.0, up), np.where(b == j, 0.0, left)
            up, left = up + value[i, j - 1], left + value[i - 1, j]
            match = value[i - 1, j - 1] + scores[:, i - 1, j - 1]
            is_up = (up > match) & (up >= left)
            is_match = ~is_up & (match >= left)
            value[i, j] = np.where(is_up, up, np.where(is_match, match, left))
            trace[i, j] = np.where(is_up, UP, np.where(is_match, DIAGONAL, LEFT))
            if mode == "local":
                low = value[i, j] <= 0
                value[i, j][low], trace[i, j][low] = 0.0, 0
                better = (value[i, j] >= best) & (i <= a) & (j <= b)
                best[better], end_i[better], end_j[better] = value[i, j][better], i, j
    row = np.arange(size)
    score = best if mode == "local" else value[a, b, row]

    def columns() -> tuple[np.ndarray, np.ndarray]:
        i, j = (end_i.copy(), end_j.copy()) if mode == "local" else (a.copy(), b.copy())
        places = np.full((2, size, n + m), -2, np.int64)
        live = np.ones(size, bool)
        for step in range(n + m):
            way = trace[i, j, row]
            live &= (i > 0) | (j > 0)
            if mode == "local":
                live &= way != 0
            if not live.any():
                break
            from_a, from_b = live & (way != UP), live & (way != LEFT)
            places[0, live, step] = np.where(from_a, i - 1, -1)[live]
            places[1, live, step] = np.where(from_b, j - 1, -1)[live]
            i, j = i - from_a, j - from_b
            if mode == "local":
                live &= value[i, j, row] > 0
        return places[0], places[1]

    return score, columns
