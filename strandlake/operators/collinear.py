"""Best collinear chains of the hits of two sequences, over whole pairs.

A chain's hits ascend in both places. A hit adds the bases that the one before it has not covered, at most k, less a quarter of
the diagonals between them (rounded down). Every earlier hit of a pair may come before a later one, however far away it is.

Pairs of few hits are chained together: those of an Arrow batch with equally many are one matrix, a hit of each at a time, which
meets all hits before it. Pairs of more than ``MANY`` hits are read as a stream and each hit finds the best one before it in
staircases: the penalty is split into a part of either hit, by the remainder of the earlier one's diagonal by four, so of hits that
a later one may follow at the same gain only those matter that beat all of nearer diagonals. So time follows the hits times
the square of a logarithm, and no array holds a pair's hits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandlake.functions.batches import prepared

#: Hits of a pair that meet all hits before them.
MANY = 2048
RESULT = ("score", "n_seeds", "query_start", "query_end", "ref_start", "ref_end")

# A chain as one number, greater for the better one: score, least start in the reference, then in the query, hits.
_BITS, _PLACE = 96, (1 << 32) - 1


def few(r: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``RESULT`` of pairs of equally many hits: a row of places each, ascending by (r, q)."""
    n = r.shape[1]
    bits = n.bit_length()
    # score, first hit (the earlier is greater), hits
    best = np.empty(r.shape, np.int64)
    for j in range(n):
        best[:, j] = (k << 2 * bits) + ((n - 1 - j) << bits) + 1
        if j:
            dr, dq = r[:, j : j + 1] - r[:, :j], q[:, j : j + 1] - q[:, :j]
            gain = np.minimum(np.minimum(dr, dq), k) - (np.abs(dr - dq) >> 2)
            joined = np.where((dr > 0) & (dq > 0), best[:, :j] + (gain << 2 * bits) + 1, 0)
            best[:, j] = np.maximum(best[:, j], joined.max(axis=1))
    last = n - 1 - np.argmax(best[:, ::-1], axis=1)  # of equal ones the last
    row = np.arange(len(r))
    top = best[row, last]
    first = n - 1 - ((top >> bits) & ((1 << bits) - 1))
    return np.stack([top >> 2 * bits, top & ((1 << bits) - 1), q[row, first], q[row, last] + k, r[row, first], r[row, last] + k], axis=1)


class _Stairs:
    """The greatest key up to a place. Keys that one at a smaller place equals or beats are not held."""

    __slots__ = ("at", "keys")

    def __init__(self) -> None:
        self.at: list[int] = []
        self.keys: list[int] = []

    def add(self, at: int, key: int) -> bool:
        begin = end = bisect_right(self.at, at)
        if begin and self.keys[begin - 1] >= key:
            return False
        while end < len(self.keys) and self.keys[end] <= key:
            end += 1
        if begin and self.at[begin - 1] == at:
            begin -= 1
        self.at[begin:end] = [at]
        self.keys[begin:end] = [key]
        return True

    def upto(self, at: int) -> int | None:
        i = bisect_right(self.at, at)
        return self.keys[i - 1] if i else None

    def forget(self, at: int) -> None:
        """Nothing before this place will be asked for."""
        i = bisect_right(self.at, at) - 1
        if i > 32:
            del self.at[:i], self.keys[:i]


def _four() -> tuple[_Stairs, ...]:
    return _Stairs(), _Stairs(), _Stairs(), _Stairs()


class Many:
    """The best chain of a pair's hits, which come ascending by (r, q); ``last`` is the greatest q of all.

    A hit's diagonal is d = r - q. Hits before it on lower diagonals or its own are nearer in the query, those on higher ones in
    the reference. The former are found by columns: the last k - 1 one by one, as their gain is less than k, and all before them in
    a Fenwick tree. The latter are found by rows: the last k - 1, and all before them in one staircase for each remainder.
    """

    def __init__(self, k: int, last: int) -> None:
        self.k, self.last, self.best = k, last, None
        self.columns: dict[int, tuple[_Stairs, ...]] = {}
        self.tree: dict[int, tuple[_Stairs, ...]] = {}
        self.row, self.now, self.rows = -1, _four(), deque()
        self.above = _four()

    def _turn(self, r: int) -> None:
        """On to another row: the one that ends can be followed, and those k bases back are all of one gain."""
        self.rows.append((self.row, self.now))
        self.row, self.now = r, _four()
        while self.rows and self.rows[0][0] <= r - self.k:
            for held, old in zip(self.above, self.rows.popleft()[1], strict=True):
                for at, key in zip(old.at, old.keys, strict=True):
                    held.add(at, key)
        for held in self.above:  # no later hit is on a diagonal below r - last
            i = bisect_right(held.at, self.last - r)
            del held.at[i:], held.keys[i:]

    def add(self, r: int, q: int) -> None:
        if r != self.row:
            self._turn(r)
        k, d = self.k, r - q
        # frames of staircases that hold hits which this one may follow, with the gain before the penalty
        below = [(x, q - c) for c in range(max(q - k + 1, 0), q) if (x := self.columns.get(c)) is not None]
        node = q + 1 - k
        while node > 0:
            if (x := self.tree.get(node)) is not None:
                below.append((x, k))
            node &= node - 1
        above = [(x, r - row) for row, x in self.rows]
        above.append((self.above, k))
        best = (k << _BITS) + ((_PLACE - r) << 64) + ((_PLACE - q) << 32) + 1
        for c in range(4):
            for frames, place, penalty in ((below, d, (d - c) // 4), (above, -d, (c - d) // 4)):
                for stairs, gain in frames:
                    if (key := stairs[c].upto(place)) is not None:
                        best = max(best, key + ((gain - penalty) << _BITS) + 1)
        if self.best is None or best >= self.best[0]:
            self.best = best, r, q
        c, part = d % 4, d // 4 << _BITS
        self.now[c].add(-d, best - part)
        least = r - self.last
        column = self.columns.setdefault(q, _four())[c]
        column.add(d, best + part)
        column.forget(least)
        node = q + 1
        while node <= self.last + 1:
            stairs = self.tree.setdefault(node, _four())[c]
            if not stairs.add(d, best + part):
                break  # what beats it is in the nodes above too
            stairs.forget(least)
            node += node & -node

    def result(self) -> list[int]:
        top, r, q = self.best
        return [top >> _BITS, top & _PLACE, _PLACE - (top >> 32 & _PLACE), q + self.k, _PLACE - (top >> 64 & _PLACE), r + self.k]


def best_chains(hits: DataFrame, keys: list[str], k: int, many: int = MANY) -> DataFrame:
    """The keys and ``RESULT`` of the best chain of each group of hits (r, q). Equal scores: the least start in the reference, then in the query."""
    prepared()
    fields = [StructField(c, hits.schema[c].dataType) for c in keys] + [StructField(c, IntegerType() if c == "n_seeds" else LongType()) for c in RESULT]

    def made(heads: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows[:, i].astype(np.int32 if c == "n_seeds" else np.int64)) for i, c in enumerate(RESULT)]
        return pa.RecordBatch.from_arrays([heads[c] for c in keys] + columns, names=[*keys, *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pair = head = None  # of a pair that goes on in the next batch: its rows, or what its hits have made and its keys
        for batch in batches:
            if rest is not None:
                batch, rest = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0], None
            place, n, r, q, last = (np.asarray(batch[c]) for c in ("place", "n", "r", "q", "last"))
            begins = np.flatnonzero(place == 1)
            sizes = n[begins]
            if len(begins) and sizes[-1] <= many and begins[-1] + sizes[-1] > len(n):
                rest = batch.slice(begins[-1])
                begins, sizes = begins[:-1], sizes[:-1]
            for size in np.unique(sizes[sizes <= many]).tolist():
                some = begins[sizes == size]
                at = some[:, None] + np.arange(size)
                yield made(batch.take(pa.array(some)), few(r[at], q[at], k))
            at = np.flatnonzero(n > many)
            for p, all_, x, y, reach, i in zip(*(v[at].tolist() for v in (place, n, r, q, last)), at.tolist(), strict=True):
                if p == 1:
                    pair, head = Many(k, reach), batch.slice(i, 1)
                pair.add(x, y)
                if p == all_:
                    yield made(head, np.array([pair.result()], np.int64))
                    pair = head = None

    group = Window.partitionBy(*keys)
    order = group.orderBy("r", "q")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = hits.select(*keys, F.col("r").cast("bigint").alias("r"), F.col("q").cast("bigint").alias("q"))
    numbered = numbered.select(*keys, "r", "q", F.row_number().over(order).cast("bigint").alias("place"), F.count("*").over(whole).alias("n"), F.max("q").over(whole).alias("last"))
    return numbered.sortWithinPartitions(*keys, "r", "q").mapInArrow(run, StructType(fields))
