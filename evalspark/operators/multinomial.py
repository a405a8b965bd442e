"""Seeded multinomial counts by a splitting tree.

How many of n draws fall to the left half of a node is binomial, and what falls to it is split again, so that any part of a
multinomial draw can be made by itself, from the counts on its path. Binomials are sums of ones of fixed sizes, each looked up in a
table of thresholds by a hash of (seed, node, replicate, number): the work grows with the logarithm of n, and another engine can repeat it.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

#: A binomial of n draws is a sum of binomials of these sizes, the largest first, and of one of what is left.
SIZES = (1 << 30, 1 << 24, 1 << 18, 1 << 12)
SMALL = 64
#: Places of a range that are drawn one by one; the tree splits larger ranges.
LEAF = 64
#: Bytes of weights that a task keeps at once.
KEPT = 64 << 20
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT, _FACTOR = np.uint64(16), np.uint64(0x45D9F3B)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 32-bit numbers, held in 64 bits."""
    for _ in range(2):
        x = (((x >> _SHIFT) ^ x) * _FACTOR) & _LOW
    return (x >> _SHIFT) ^ x


def node_key(seed: int, node: int) -> np.uint64:
    return scrambled(scrambled(np.array([seed & 0xFFFFFFFF], dtype=np.uint64)) ^ np.uint64(node))[0]


def thresholds(size: int, p: float) -> tuple[int, np.ndarray]:
    """(k, t): floor(2**32 * P(X <= k + i)) for a binomial X of size draws, within 12 standard deviations of its mean."""
    spread = 12 * np.sqrt(size * p * (1 - p)) + 12
    lo, hi = max(0, int(size * p - spread)), min(size, int(size * p + spread) + 1)
    k = np.arange(lo, hi, dtype=float)
    logs = np.concatenate(([0.0], np.cumsum(np.log((size - k) / (k + 1)) + np.log(p / (1 - p)))))
    mass = np.exp(logs - logs.max())
    t = np.floor(np.cumsum(mass) / mass.sum() * 2.0**32).astype(np.uint64)
    t[-1] = 1 << 32
    return lo, t


def small_thresholds(p: float) -> np.ndarray:
    """A row for each size up to SMALL: floor(2**32 * P(X <= k)) for k up to the size, then 2**32."""
    out, mass = np.full((SMALL + 1, SMALL + 1), 1 << 32, dtype=np.uint64), np.zeros(SMALL + 1)
    mass[0] = 1.0
    for size in range(1, SMALL + 1):
        mass[1:] = mass[1:] * (1 - p) + mass[:-1] * p
        mass[0] *= 1 - p
        out[size, :size] = np.floor(np.cumsum(mass[:size]) * 2.0**32).astype(np.uint64)
    return out


def binomial(n: np.ndarray, p: float, key: np.uint64) -> np.ndarray:
    """How many of n[b] draws succeed, for each replicate b."""
    if p <= 0 or p >= 1:
        return n * int(p >= 1)
    left, found, told = n.copy(), np.zeros_like(n), np.zeros(len(n), dtype=np.uint64)
    streams = scrambled(np.arange(len(n), dtype=np.uint64) ^ key)

    def units(at: np.ndarray) -> np.ndarray:
        u = scrambled(streams[at] ^ told[at])
        told[at] += np.uint64(1)
        return u

    table = small_thresholds(p)
    for size in (*SIZES, SMALL):
        if (most := int(left.max(initial=0)) // size) > 0:
            first, t = (0, table[SMALL]) if size == SMALL else thresholds(size, p)
            for k in range(most):
                at = np.flatnonzero(left >= size)
                found[at] += first + np.searchsorted(t, units(at), side="right")
                left[at] -= size
    at = np.flatnonzero(left)
    found[at] += (table[left[at]] <= units(at)[:, None]).sum(axis=1)
    return found


def multinomial(counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A row for each of counts: how often each of draws replicates draws it, of as many draws as the counts' sum, in proportion to them."""
    ranges = 1 << max(0, int(len(counts) - 1).bit_length())
    sums = np.zeros(2 * ranges, dtype=np.int64)
    sums[ranges : ranges + len(counts)] = counts
    for node in range(ranges - 1, 0, -1):
        sums[node] = sums[2 * node] + sums[2 * node + 1]
    drawn = {1: np.full(draws, sums[1], dtype=np.int64)}
    for node in range(1, ranges):
        n = drawn.pop(node)
        drawn[2 * node] = binomial(n, sums[2 * node] / sums[node] if sums[node] else 0.0, node_key(seed, node))
        drawn[2 * node + 1] = n - drawn[2 * node]
    return np.stack([drawn[ranges + k] for k in range(len(counts))]).astype(np.int32 if sums[1] < 1 << 31 else np.int64)


class Tree:
    """The weights of groups that have a place in one of a power of two of ranges; counts: the groups of each range."""

    def __init__(self, counts: np.ndarray, draws: int, seed: int) -> None:
        self.counts, self.draws, self.seed, self.totals = counts, draws, seed, multinomial(counts, draws, seed)
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": OrderedDict()}

    def leaf(self, r: int, place: int) -> tuple[int, np.ndarray]:
        """The first place of the leaf of this place, and the weights of its places: a row for each, a column for each replicate."""
        first, size, n, key = 0, int(self.counts[r]), None, None
        path = []
        while size > LEAF:
            half = size // 2
            path.append((half, size, place >= first + half))
            first, size = (first + half, size - half) if place >= first + half else (first, half)
        if (found := self.kept.get((r, first))) is not None:
            self.kept.move_to_end((r, first))
            return first, found
        n, key = self.totals[r], node_key(self.seed, len(self.counts) + r)
        for half, whole, right in path:
            part = binomial(n, half / whole, key)
            n, key = (n - part, self._below(key, 2)) if right else (part, self._below(key, 1))
        found = drawn(n, size, key)
        self.kept[r, first] = found
        while len(self.kept) > 1 and len(self.kept) * found.nbytes > KEPT:
            self.kept.popitem(last=False)
        return first, found

    @staticmethod
    def _below(key: np.uint64, side: int) -> np.uint64:
        return scrambled(np.array([(int(key) + side) & 0xFFFFFFFF], dtype=np.uint64))[0]


def drawn(n: np.ndarray, size: int, key: np.uint64) -> np.ndarray:
    """How often n[b] draws fall on each of size places: a row for each place."""
    b = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
    u = scrambled(scrambled(np.arange(len(n), dtype=np.uint64) ^ key)[b] ^ j.astype(np.uint64))
    place = ((u * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
    return np.bincount(place * len(n) + b, minlength=size * len(n)).reshape(size, len(n)).astype(np.int32)
