"""Patterns of lengths that fill sequences: a cutting-stock linear program over a length histogram, by column generation.

The input is a histogram of at most ``capacity`` lengths, so the work on the driver doesn't grow with the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FINE = 6  # lengths of more bits than this share a class with those that have the same FINE + 1 leading bits


def top(length: int, fine: int = FINE) -> int:
    """The greatest length of a length's class: exact below 2^(fine+1), then classes as wide as a 2^fine-th of it."""
    width = max(1, 1 << max(0, length.bit_length() - 1 - fine))
    return -(-length // width) * width


@dataclass
class Pattern:
    """So many sequences that hold counts[i] documents of class i each."""

    counts: np.ndarray
    times: int


class _Knapsack:
    """Best values of all fills up to the capacity, by dynamic programming over any number of each length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")

    def solve(self, values: np.ndarray) -> float:
        best, took = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        lengths = self.lengths
        for s in range(1, self.capacity + 1):
            best[s] = best[s - 1]
            k = self.upto[s]
            if k:
                got = best[s - lengths[:k]] + values[:k]
                i = int(got.argmax())
                if got[i] > best[s] + 1e-12:
                    best[s], took[s] = got[i], i
        self.best, self.took = best, took.tolist()
        return float(best[-1])

    def pattern(self, space: int) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int64)
        while space > 0:
            i = self.took[space]
            if i < 0:
                space -= 1
            else:
                out[i] += 1
                space -= int(self.lengths[i])
        return out

    def columns(self) -> np.ndarray:
        """For each length the best pattern that has it, and the best one of all: one solution prices many columns."""
        made = [self.pattern(self.capacity)]
        for i, n in enumerate(self.lengths.tolist()):
            p = self.pattern(self.capacity - n)
            p[i] += 1
            made.append(p)
        return np.unique(np.array(made), axis=0).T


def longest_first(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns of the longest that still fit, each used as often as what remains allows."""
    out, rest = [], demand.astype(np.int64)
    while rest.any():
        a, space = np.zeros_like(rest), capacity
        for i in np.flatnonzero(rest)[::-1]:
            a[i] = min(rest[i], space // lengths[i])
            space -= int(a[i] * lengths[i])
        used = a > 0
        out.append(Pattern(a, int((rest[used] // a[used]).min())))
        rest = rest - a * out[-1].times
    return out


def relax(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (columns), how often each is used (fractions), and a lower bound of the number of sequences.

    Revised simplex over the patterns known; a knapsack finds those that would improve it.  It ends where the sum is
    within gap (or half a sequence) of the bound that the dual values prove, or nothing improves.
    """
    m = len(lengths)
    pool = np.array([p.counts for p in longest_first(lengths, demand, capacity)], float).T
    columns = np.diag(capacity // lengths).astype(float)
    asked, demand = demand, demand + np.random.default_rng(m).uniform(1e-4, 1e-3, m)  # no ties, so that no step has length zero
    inverse, x = np.diag(1 / np.diag(columns)), demand / np.diag(columns)
    pack, pivots = _Knapsack(lengths, capacity), 0
    bound = float(lengths @ asked) / capacity  # lengths as dual values
    while True:
        duals = inverse.sum(0)
        gain = duals @ pool
        if gain.max() <= 1 + 1e-7:
            value = pack.solve(duals)
            bound = max(bound, float(duals @ asked) / max(value, 1.0))
            if value <= 1 + 1e-6 or x.sum() - bound <= max(gap * x.sum(), 0.5):
                return columns, x, bound
            pool = pack.columns().astype(float)
            gain = duals @ pool
        enter = pool[:, int(gain.argmax())]
        way = inverse @ enter
        ratio = np.where(way > 1e-7, x / np.where(way > 1e-7, way, 1), np.inf)
        r = int(ratio.argmin())
        if ratio[r] == np.inf or pivots > 30 * m + 1000:  # what is known is good enough: any basis is a packing
            return columns, x, bound
        step = ratio[r]
        x = np.maximum(x - step * way, 0)
        x[r] = step
        columns[:, r] = enter
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
        pivots += 1
        if pivots % 200 == 0:  # rounding errors don't add up
            try:
                inverse = np.linalg.inv(columns)
            except np.linalg.LinAlgError:
                return columns, x, bound
            x = np.maximum(inverse @ demand, 0)


def patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[list[Pattern], float]:
    """Patterns that hold every document once, the fullest first, and the program's lower bound.

    Fractions are rounded down; what remains is packed by taking the longest that fit, as often as the rest allows.
    """
    if not len(lengths):
        return [], 0.0
    columns, x, bound = relax(lengths, demand.astype(float), capacity, gap)
    out, rest = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        times, a = int(x[j] + 1e-6), columns[:, j].astype(np.int64)
        if times and (used := a > 0).any():
            times = min(times, int((rest[used] // a[used]).min()))
        if times:
            out.append(Pattern(a, times))
            rest -= a * times
    out += longest_first(lengths, rest, capacity)
    return sorted(out, key=lambda p: -int(p.counts @ lengths)), bound
