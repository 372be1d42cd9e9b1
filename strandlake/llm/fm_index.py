"""A compressed FM-index over a word alphabet, with vectorised backward search.

The Burrows-Wheeler transform is held in a wavelet matrix of packed bit vectors: a bit and a half for each symbol and
level. Suffixes are sorted to ``2 ** rounds`` symbols, which is all that patterns of fewer symbols need.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(-n % 64 + 64, bool)], bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Rank of symbols below 2 ** levels in a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels: list[Bits] = []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            now = np.concatenate((now[~bits], now[bits]))
        # where a symbol's run begins in the last order
        first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
        self.begin = np.zeros(int(symbols.max()) + 1, np.int64)
        self.begin[now[first]] = first

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        n = len(self.levels)
        at = i
        for k, level in enumerate(self.levels):
            ones = level.ones_before(at)
            at = np.where(symbol >> (n - 1 - k) & 1, level.zeros + ones, at - ones)
        return at - self.begin[symbol]


def depth_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of suffixes by 2 ** rounds > depth symbols, ranks of their first ``depth`` symbols, and the symbols sorted by."""
    n, ranks = len(symbols), {1: symbols.astype(np.int64)}
    h = 1
    while h <= depth:
        r = ranks[h]
        later = np.zeros(n, np.int64)
        later[: max(n - h, 0)] = r[h:] + 1
        ranks[2 * h] = np.unique(r * (int(r.max()) + 2) + later, return_inverse=True)[1]
        h *= 2
    # the depth's binary digits, most significant first, give ranks of exactly that many symbols
    done, group = 0, np.zeros(n, np.int64)
    for bit in sorted((b for b in ranks if depth & b), reverse=True):
        part = np.zeros(n, np.int64)
        part[: max(n - done, 0)] = ranks[bit][done:] + 1
        group = np.unique(group * (int(part.max()) + 1) + part, return_inverse=True)[1]
        done += bit
    return np.argsort(ranks[h], kind="stable"), group, h


class FMIndex:
    """symbols: from 1 on, with 0 between texts. depth: the length of matches that are asked for."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.n, self.depth = len(symbols), depth
        self.suffixes, group, _ = depth_order(symbols, depth)
        before = symbols[self.suffixes - 1]
        top = int(symbols.max())
        self.transform = WaveletMatrix(before, max(top.bit_length(), 1))
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=top + 1))]
        in_order = group[self.suffixes]
        edge = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
        #: For each place, the interval of suffixes with the same first ``depth`` symbols.
        self.group = np.cumsum(np.r_[False, in_order[1:] != in_order[:-1]])
        self.low, self.high = edge, np.r_[edge[1:], self.n]

    def intervals(self, texts: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Matching statistics of texts, right to left: for each position at which ``depth`` symbols match, (text, position, interval).

        texts: symbols of all texts; start, length: where each stands. A match longer than the depth is shortened to it by
        the interval of its first ``depth`` symbols. Yields arrays, a batch for each step; texts that stop matching begin anew.
        """
        order = np.argsort(-length, kind="stable")
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        matched = np.zeros(len(order), np.int64)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length[order], -t))  # the first ones are longer than t
            mine = order[:live]
            c = texts[start[mine] + length[mine] - 1 - t]
            known = c < len(self.transform.begin)
            safe = np.where(known, c, 0)
            base = self.less[safe]
            new_lo, new_hi = base + self.transform.step(safe, lo[:live]), base + self.transform.step(safe, hi[:live])
            empty = ~known | (new_lo >= new_hi)
            matched[:live] = np.where(empty, 0, matched[:live] + 1)
            lo[:live], hi[:live] = np.where(empty, 0, new_lo), np.where(empty, self.n, new_hi)
            full = np.flatnonzero(matched[:live] >= self.depth)
            if len(full):
                g = self.group[lo[full]]
                lo[full], hi[full] = self.low[g], self.high[g]
                matched[full] = self.depth
                yield mine[full], start[mine[full]] + length[mine[full]] - 1 - t, g
