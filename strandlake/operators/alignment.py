"""Pairwise alignment with affine gaps, in Arrow batches.

A gap of k costs ``gap_open + (k - 1) * gap_extend``, both from -127 to 0 and the extension no worse than the opening. A row
of the matrix is filled at once, for all pairs of like size in a batch together: gaps in the reference direction come from
the row above, and gaps along the row are a running maximum, because a gap that follows another gap is never better than
one longer gap. Of equal scores the first in
row order is the end; the way back prefers to go on with a gap, then deletions, insertions and matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.shipping import ship

ALIGNMENT = "status string, score bigint, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, cigar string, ref_len bigint, query_len bigint"
UP, LEFT, STOP, UP_MORE, LEFT_MORE = 1, 2, 4, 8, 16
NONE = -(1 << 29)


@dataclass(frozen=True)
class Weights:
    """Scores of letters: an alphabet, its table by rows (reference) and columns (query), and the letter that others become."""

    alphabet: str
    table: tuple[tuple[int, ...], ...]
    rest: str
    synonyms: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def simple(alphabet: str, match: int, mismatch: int, ignoring: str | None = None, rest: str | None = None, synonyms: tuple[tuple[str, str], ...] = ()) -> Weights:
        """One score for equal letters, one for others, 0 against the ignored letter."""
        rows = tuple(tuple(0 if ignoring in (a, b) else match if a == b else mismatch for b in alphabet) for a in alphabet)
        return Weights(alphabet, rows, rest or ignoring or alphabet[0], synonyms)

    @staticmethod
    def dna(match: int, mismatch: int, ignoring: str | None = "N") -> Weights:
        return Weights.simple("ACGTN", match, mismatch, ignoring, "N", (("U", "T"),))

    @staticmethod
    def from_function(alphabet: str, score, rest: str | None = None) -> Weights:
        """``score(reference letter, query letter)`` for each pair of letters."""
        return Weights(alphabet, tuple(tuple(int(score(a, b)) for b in alphabet) for a in alphabet), rest or alphabet[0])

    def subset(self, alphabet: str, rest: str | None = None) -> Weights:
        """The scores of some letters, in this order."""
        if not set(alphabet) <= set(self.alphabet):
            raise ValueError("the letters are not a subset of the matrix's")
        at = [self.alphabet.index(c) for c in alphabet]
        return Weights(alphabet, tuple(tuple(self.table[i][j] for j in at) for i in at), rest or (self.rest if self.rest in alphabet else alphabet[0]), tuple((a, b) for a, b in self.synonyms if b in alphabet))

    def biased(self) -> tuple[Weights, int]:
        """The matrix shifted so that no score is negative, and the shift (0 or the least score)."""
        bias = min(0, min(map(min, self.table)))
        return Weights(self.alphabet, tuple(tuple(x - bias for x in row) for row in self.table), self.rest, self.synonyms), bias

    def get(self, ref: str, query: str) -> int:
        return int(self.array()[self._lookup()[ord(ref)], self._lookup()[ord(query)]])

    def text(self) -> str:
        """The usual text form, as ``parse_matrix`` reads it."""
        return "\n".join(["  " + " ".join(f"{c:>3}" for c in self.alphabet), *(a + " " + " ".join(f"{x:>3}" for x in row) for a, row in zip(self.alphabet, self.table, strict=True))]) + "\n"

    def codes(self, text: str) -> np.ndarray:
        lut = self._lookup()
        return lut[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]

    @lru_cache(maxsize=8)  # noqa: B019
    def _lookup(self) -> np.ndarray:
        lut = np.full(256, self.alphabet.index(self.rest), np.int64)
        for i, c in enumerate(self.alphabet):
            lut[[ord(c), ord(c.lower()), ord(c.upper())]] = i
        for a, b in self.synonyms:
            lut[[ord(a), ord(a.lower())]] = self.alphabet.index(b)
        return lut

    @lru_cache(maxsize=8)  # noqa: B019
    def array(self) -> np.ndarray:
        return np.array(self.table, np.int64)


def check_gaps(gap_open: int, gap_extend: int) -> None:
    if not (-127 <= gap_open <= 0 and -127 <= gap_extend <= 0 and gap_extend >= gap_open):
        raise ValueError("gap scores must be from -127 to 0, the extension no worse than the opening")


def run_lengths(ops: list[tuple[int, str]]) -> str:
    out: list[list] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def padded(codes: list[np.ndarray]) -> np.ndarray:
    """Sequences as rows of one array, filled up with the first letter."""
    out = np.zeros((len(codes), max(map(len, codes), default=0)), np.intp)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


class Rows:
    """The rows of many matrices, one after another: pairs of like size are filled in step.

    What stands right of a query's end never reaches a cell left of it, so padding changes nothing; best scores are taken
    from each pair's own cells. ``state`` and ``restore`` let a matrix be filled again from a row on.
    """

    def __init__(self, refs: list[np.ndarray], queries: list[np.ndarray], weights: np.ndarray, go: int, ge: int, mode: str, band: int | None = None) -> None:
        self.ref, self.query, self.weights, self.go, self.ge = padded(refs), padded(queries), weights.astype(np.int32), go, ge
        self.n, self.m = np.array([len(x) for x in refs]), np.array([len(x) for x in queries])
        self.local, self.band, self.r = mode == "local", band, 0
        b, m = self.query.shape
        self.col = np.arange(m, dtype=np.int32)
        self.own = self.col[None, :] < self.m[:, None]
        self.above = np.zeros((b, m), np.int32) if self.local else np.repeat((go + ge * self.col)[None, :], b, 0)
        self.gap = self.above + np.int32(go)  # E: ends with a gap that consumes the reference
        if band is not None and not self.local:
            self.gap[:, band + 1 :] = NONE  # what the band has not reached yet
        self.best, self.at = np.zeros(b, np.int64), np.zeros((b, 2), np.int64)
        if not self.local:
            self.best = np.where(self.n > 0, 0, go + ge * (self.m - 1)).astype(np.int64)
            self.at = np.column_stack((self.n - 1, self.m - 1))

    def state(self) -> tuple:
        return self.r, self.above.copy(), self.gap.copy()

    def restore(self, state: tuple) -> None:
        self.r, self.above, self.gap = state[0], state[1].copy(), state[2].copy()

    def step(self, trace: bool = False) -> np.ndarray | None:
        """Fills the next row; its flags if asked for. Right of the band nothing is filled."""
        r, go, ge = self.r, self.go, self.ge
        self.r += 1
        b, m = self.query.shape
        lo, hi = (0, m) if self.band is None else (max(0, r - self.band), min(m, r + self.band + 1))
        flags = np.zeros((b, m), np.uint8) if trace else None
        if lo >= hi:
            return flags
        edge = 0 if self.local or r == 0 else go + ge * (r - 1)  # left of the row above
        left = 0 if self.local else go + ge * r  # left of this row
        x = np.empty((b, hi - lo), np.int32)
        x[:, 1:] = self.above[:, lo : hi - 1]
        x[:, 0] = self.above[:, lo - 1] if lo else edge
        x += self.weights[self.ref[:, r][:, None], self.query[:, lo:hi]]
        e = self.gap[:, lo:hi]
        np.maximum(x, e, out=x)
        if self.local:
            np.maximum(x, 0, out=x)
        place = self.col[: hi - lo] * np.int32(ge)
        run = np.empty((b, hi - lo), np.int32)
        run[:, 0] = left + go if lo == 0 else go if self.local else NONE
        run[:, 1:] = x[:, :-1] - place[:-1] + np.int32(go - ge)
        f = np.maximum.accumulate(run, axis=1)
        f += place
        h = np.maximum(x, f)
        if self.local:
            top = np.where(self.own[:, lo:hi], h, -1)
            c = top.argmax(1)
            value = top[np.arange(b), c]
            new = (value > self.best) & (r < self.n)
            self.best[new], self.at[new, 0], self.at[new, 1] = value[new], r, lo + c[new]
        else:
            done = np.flatnonzero(self.n - 1 == r)
            last = self.m[done] - 1
            inside = (last >= lo) & (last < hi)
            self.best[done] = np.where(inside, h[done, np.clip(last - lo, 0, hi - lo - 1)], self.above[done, last])
        opened = h + np.int32(go)
        if trace:
            mark = UP * (e == h) + LEFT * (f == h)
            more = UP_MORE * (e + ge > opened) + LEFT_MORE * (f + ge > opened)
            if self.local:
                mark = mark + STOP * (h == 0)
                more = np.where(h == 0, 0, more)
            flags[:, lo:hi] = mark + more
        self.gap[:, lo:hi] = np.maximum(e + np.int32(ge), opened)
        self.above[:, lo:hi] = h
        return flags


def fill(ref: np.ndarray, query: np.ndarray, weights: np.ndarray, go: int, ge: int, mode: str, band: int | None = None, trace: bool = True):
    """(best score, its row, its column, flags) of one pair. mode: local or global."""
    rows = Rows([ref], [query], weights, go, ge, mode, band)
    flags = np.zeros((len(ref), len(query)), np.uint8) if trace else None
    for r in range(len(ref)):
        f = rows.step(trace)
        if trace:
            flags[r] = f[0]
    return int(rows.best[0]), int(rows.at[0, 0]), int(rows.at[0, 1]), flags


class Blocks:
    """Flags of a matrix that is too large to keep: rows are kept at intervals, and the flags between two of them are filled
    again when the way back comes there. Cell by cell they are those of the whole matrix."""

    def __init__(self, ref: np.ndarray, query: np.ndarray, weights: np.ndarray, go: int, ge: int, mode: str, band: int | None = None) -> None:
        self.rows = Rows([ref], [query], weights, go, ge, mode, band)
        self.every = max(int(len(ref) ** 0.5), 1)
        self.kept = []
        for r in range(len(ref)):
            if r % self.every == 0:
                self.kept.append(self.rows.state())
            self.rows.step()
        self.best, self.r, self.c = int(self.rows.best[0]), int(self.rows.at[0, 0]), int(self.rows.at[0, 1])
        self.block, self.held = -1, np.zeros((0, 0), np.uint8)

    def __getitem__(self, place: tuple[int, int]) -> int:
        r, c = place
        if r // self.every != self.block:
            self.block = r // self.every
            self.rows.restore(self.kept[self.block])
            self.held = np.concatenate([self.rows.step(True) for _ in range(min(self.every, self.rows.ref.shape[1] - self.block * self.every))])
        return self.held[r % self.every, c]


def in_step(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int):
    """Indices of pairs in groups of like size whose padded matrices have up to ``cells`` cells together (or one pair)."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    group: list[int] = []
    n = m = 0
    for i in order:
        a, b = max(n, len(pairs[i][0])), max(m, len(pairs[i][1]))
        if group and a * b * (len(group) + 1) > cells:
            yield group
            group, a, b = [], len(pairs[i][0]), len(pairs[i][1])
        group.append(i)
        n, m = a, b
    if group:
        yield group


def way_back(flags: np.ndarray, r: int, c: int, local: bool) -> tuple[int, int, list[tuple[int, str]]]:
    """Where the alignment starts, and its operations from the end on."""
    ops: list[tuple[int, str]] = []
    op = ""
    r, c = r + 1, c + 1
    while r > 0 and c > 0:
        f = flags[r - 1, c - 1]
        if local and f & STOP:
            break
        if op == "D" and f & UP_MORE or not (op == "I" and f & LEFT_MORE) and f & UP:
            op = "D"
        elif op == "I" and f & LEFT_MORE or f & LEFT:
            op = "I"
        else:
            op = "M"
        r -= op != "I"
        c -= op != "D"
        ops.append((1, op))
    return r, c, ops


def result(mode: str, n: int, m: int, score: int, r: int, c: int, flags) -> tuple:
    """One alignment, in the order of ALIGNMENT."""
    if mode == "global":
        if not n:
            return "Some", score, 0, 0, 0, m, f"{m}I", 0, m
        i, j, ops = way_back(flags, r, c, False)
        return "Some", score, 0, n, 0, m, run_lengths([(i, "D"), (j, "I"), *reversed(ops)]), n, m
    if score <= 0:
        return "Unmapped", None, None, None, None, None, None, n, m
    i, j, ops = way_back(flags, r, c, True)
    return "Some", score, i, r + 1, j, c + 1, run_lengths([(j, "S"), *reversed(ops), (m - c - 1, "S")]), n, m


def align_pairs(pairs: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, go: int, ge: int, mode: str = "local", band: int | None = None, cells: int = 1 << 24) -> list[tuple]:
    """Alignments of encoded pairs (reference, query). cells: how many cells' flags are held at a time (a byte each)."""
    out: list = [None] * len(pairs)
    for group in in_step(pairs, cells):
        refs, queries = [pairs[i][0] for i in group], [pairs[i][1] for i in group]
        if len(group) == 1 and len(refs[0]) * len(queries[0]) > cells:
            flags = Blocks(refs[0], queries[0], weights, go, ge, mode, band)
            out[group[0]] = result(mode, len(refs[0]), len(queries[0]), flags.best, flags.r, flags.c, flags)
            continue
        rows = Rows(refs, queries, weights, go, ge, mode, band)
        steps = [rows.step(True) for _ in range(rows.ref.shape[1])]
        flags = np.stack(steps, 1) if steps else np.zeros((len(group), 0, 0), np.uint8)
        for k, i in enumerate(group):
            out[i] = result(mode, len(refs[k]), len(queries[k]), int(rows.best[k]), int(rows.at[k, 0]), int(rows.at[k, 1]), flags[k])
    return out


def score_pairs(pairs: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, go: int, ge: int, mode: str = "local") -> list[tuple[int, int, int]]:
    """(best score, its row, its column) of encoded pairs: a row of each matrix is kept at a time."""
    out: list = [None] * len(pairs)
    for group in in_step(pairs, 1 << 24):
        rows = Rows([pairs[i][0] for i in group], [pairs[i][1] for i in group], weights, go, ge, mode)
        for _ in range(rows.ref.shape[1]):
            rows.step()
        for k, i in enumerate(group):
            out[i] = int(rows.best[k]), int(rows.at[k, 0]), int(rows.at[k, 1])
    return out


def align_pair(ref: str, query: str, weights: Weights, go: int, ge: int, mode: str = "local", band: int | None = None) -> tuple:
    """One alignment, in the order of ALIGNMENT."""
    if not query:
        raise ValueError("the query is empty")
    return align_pairs([(weights.codes(ref), weights.codes(query))], weights.array(), go, ge, mode, band)[0]


def ranges_of(pairs: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, go: int, ge: int) -> list[tuple | None]:
    """(score, ref_start, ref_end, query_start, query_end) of the best local alignments, without a way back.

    The second pass runs over both sequences reversed from the end on: where the score is met first, an alignment begins.
    """
    ends = score_pairs(pairs, weights, go, ge)
    live = [i for i, (s, _, _) in enumerate(ends) if s > 0]
    turned = [(pairs[i][0][: ends[i][1] + 1][::-1], pairs[i][1][: ends[i][2] + 1][::-1]) for i in live]
    out: list[tuple | None] = [None] * len(pairs)
    for i, (s, r, c) in zip(live, score_pairs(turned, weights, go, ge), strict=True):
        score, end_r, end_c = ends[i]
        out[i] = score, end_r - r, end_r + 1, end_c - c, end_c + 1
    return out


def three_pass(ref: np.ndarray, query: np.ndarray, weights: np.ndarray, go: int, ge: int) -> tuple:
    """An alignment of the best score from its ranges: without gaps where that scores as much, else in a band that doubles
    until the score is met. Of equal paths it may be another than that of the whole matrix."""
    n, m = len(ref), len(query)
    found = ranges_of([(ref, query)], weights, go, ge)[0]
    if found is None:
        return "Unmapped", None, None, None, None, None, None, n, m
    score, a, b, c, d = found
    x, y = ref[a:b], query[c:d]
    if len(x) == len(y) and int(weights[x, y].sum()) == score:
        return "Some", score, a, b, c, d, run_lengths([(c, "S"), (len(x), "M"), (m - d, "S")]), n, m
    band = max(abs(len(x) - len(y)), 1) + 1
    while True:
        got = align_pairs([(x, y)], weights, go, ge, "global", band if band < max(len(x), len(y)) else None)[0]
        if got[1] == score or band >= max(len(x), len(y)):
            return "Some", score, a, b, c, d, run_lengths([(c, "S"), *ciglets(got[6]), (m - d, "S")]), n, m
        band *= 2


class PathError(ValueError):
    """Why a path has no score; ``kind`` names the fault."""

    def __init__(self, kind: str, text: str) -> None:
        super().__init__(text)
        self.kind = kind


def rescore(ref: str, query: str, cigar: str, ref_start: int, weights: Weights, go: int, ge: int, mode: str = "local") -> int:
    """The score of an alignment from its operations alone. mode global: all of both sequences must be used."""
    a, b, w = weights.codes(ref), weights.codes(query), weights.array()
    r, q, total = ref_start, 0, 0
    if "".join(f"{n}{op}" for n, op in ciglets(cigar)) != re.sub(r"(?<![0-9])0+(?=[1-9])", "", cigar):
        raise PathError("InvalidCigar", "the operations are malformed")
    for n, op in ciglets(cigar):
        if op in "M=XDN" and r + n > len(a):
            raise PathError("ReferenceEnded", "the operations run past the reference's end")
        if op in "M=XIS" and q + n > len(b):
            raise PathError("QueryEnded", "the operations run past the query's end")
        if op in "M=X":
            total += int(w[a[r : r + n], b[q : q + n]].sum())
            r, q = r + n, q + n
        elif op in "ID":
            total += go + (n - 1) * ge
            r, q = r + n * (op == "D"), q + n * (op == "I")
        elif op == "N":
            r += n
        elif op == "S":
            q += n
    if mode == "global" and r < len(a):
        raise PathError("ReferenceLeft", "some of the reference is left")
    if q < len(b):
        raise PathError("QueryLeft", "some of the query is left")
    return total


def _frame(rows: list[tuple], schema: str = ALIGNMENT) -> pd.DataFrame:
    names = [c.split() for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in names]).astype({n: "Int64" for n, t in names if t == "bigint"})


def _encoded(a: pd.Series, b: pd.Series, weights: Weights) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """The rows that have both sequences, encoded; equal strings, such as one query against many references, once."""
    known: dict[str, np.ndarray] = {}

    def codes(x: str) -> np.ndarray:
        if x not in known:
            known[x] = weights.codes(x)
        return known[x]

    live = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if isinstance(x, str) and isinstance(y, str) and y]
    return live, [(codes(a.iloc[i]), codes(b.iloc[i])) for i in live]


def align(ref: Column, query: Column, weights: Weights, gap_open: int, gap_extend: int, mode: str = "local", band: int | None = None, *, strategy: str = "whole") -> Column:
    """An ALIGNMENT struct for each pair of columns; null where either is null or the query is empty. mode: local or global.

    strategy: "whole" fills the matrix (long pairs keep some of its rows and fill the rest again); "three_pass", for local
    alignments, finds the ranges first and then fills a band.
    """
    check_gaps(gap_open, gap_extend)
    if strategy not in ("whole", "three_pass") or strategy == "three_pass" and (mode != "local" or band is not None):
        raise ValueError("three passes are for local alignments without a band")
    ship()

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        live, pairs = _encoded(a, b, weights)
        table = weights.array()
        found = align_pairs(pairs, table, gap_open, gap_extend, mode, band) if strategy == "whole" else [three_pass(x, y, table, gap_open, gap_extend) for x, y in pairs]
        rows: list[tuple] = [(None,) * 9] * len(a)
        for i, row in zip(live, found, strict=True):
            rows[i] = row
        return _frame(rows)

    return run(ref, query)


def score(ref: Column, query: Column, weights: Weights, gap_open: int, gap_extend: int, mode: str = "local") -> Column:
    """The best score alone: a row of the matrix is kept at a time. Local scores of 0 are null (unmapped)."""
    check_gaps(gap_open, gap_extend)
    ship()

    @F.pandas_udf("bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        live, pairs = _encoded(a, b, weights)
        out: list = [None] * len(a)
        for i, (s, _, _) in zip(live, score_pairs(pairs, weights.array(), gap_open, gap_extend, mode), strict=True):
            out[i] = None if s == 0 and mode == "local" else s
        return pd.Series(out, dtype="Int64")

    return run(ref, query)


RANGES = "score bigint, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint"


def score_ranges(ref: Column, query: Column, weights: Weights, gap_open: int, gap_extend: int) -> Column:
    """A RANGES struct of the best local alignment of each pair, by two passes without a way back; nulls where unmapped."""
    check_gaps(gap_open, gap_extend)
    ship()

    @F.pandas_udf(RANGES)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        live, pairs = _encoded(a, b, weights)
        rows: list[tuple] = [(None,) * 5] * len(a)
        for i, row in zip(live, ranges_of(pairs, weights.array(), gap_open, gap_extend), strict=True):
            rows[i] = row or (None,) * 5
        return _frame(rows, RANGES)

    return run(ref, query)


def path_score(ref: Column, query: Column, alignment: Column, weights: Weights, gap_open: int, gap_extend: int, mode: str = "local") -> Column:
    """(score, error) of alignments from their operations alone; error names what is wrong with a path, else null."""
    check_gaps(gap_open, gap_extend)
    ship()

    @F.pandas_udf("score bigint, error string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for x, y, z, s in zip(a, b, c, start, strict=True):
            try:
                rows.append((rescore(x, y, z, int(s), weights, gap_open, gap_extend, mode), None) if isinstance(z, str) and isinstance(x, str) and isinstance(y, str) else (None, None))
            except PathError as e:
                rows.append((None, e.kind))
        return _frame(rows, "score bigint, error string")

    return run(ref, query, alignment["cigar"], alignment["ref_start"])


def may_align(ref: str, query: str, threshold: float) -> bool | None:
    """Whether the pair can be within ``floor(len(query) * threshold)`` edits: a lower bound that never rejects such a pair.

    From each obstacle on, the furthest stretch of equal letters over all near diagonals is crossed at once.
    """
    if not 0 <= threshold <= 1:
        return None
    edits = int(np.floor(np.float32(len(query)) * np.float32(threshold)))
    apart = abs(len(ref) - len(query))
    if apart > edits:
        return None
    if edits == len(query):
        return True
    short, long_ = (query, ref) if len(ref) > len(query) else (ref, query)
    s, t = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (short, long_))
    n, shift = len(s), apart // 2
    # for each diagonal the next place that differs
    stops = np.empty((2 * edits + 1, n + 1), np.int64)
    for d in range(2 * edits + 1):
        at = np.arange(n) + d + shift - edits
        inside = (at >= 0) & (at < len(t))
        same = np.zeros(n, bool)
        same[inside] = s[inside.nonzero()[0]] == t[at[inside]]
        wrong = np.where(same, n, np.arange(n))
        stops[d, n] = n
        stops[d, :n] = np.minimum.accumulate(wrong[::-1])[::-1]
    here = used = 0
    while here < n and used <= edits and n - here > edits - used:
        reach = int(stops[:, here].max())
        if reach > here and n - reach <= edits - used:
            return True
        here, used = reach + 1, used + 1
    return used <= edits


def pre_filter(ref: Column, query: Column, threshold: float) -> Column:
    """``may_align`` of two columns."""
    ship()

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_align(x, y, threshold) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="boolean")

    return run(ref, query)


def to_reverse(a: Column) -> Column:
    """The alignment of both sequences reversed."""
    from strandlake.functions.cigar import reversed_cigar

    return a.withField("ref_start", a["ref_len"] - a["ref_end"]).withField("ref_end", a["ref_len"] - a["ref_start"]).withField("query_start", a["query_len"] - a["query_end"]).withField("query_end", a["query_len"] - a["query_start"]).withField("cigar", reversed_cigar(a["cigar"]))


def invert(a: Column) -> Column:
    """The alignment with the roles of reference and query exchanged: clips are those of the other side."""
    from strandlake.functions.cigar import inverted

    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise(F.lit(""))
    body = F.concat(clip(a["ref_start"]), inverted(a["cigar"]), clip(a["ref_len"] - a["ref_end"]))
    return F.struct(a["status"].alias("status"), a["score"].alias("score"), a["query_start"].alias("ref_start"), a["query_end"].alias("ref_end"), a["ref_start"].alias("query_start"), a["ref_end"].alias("query_end"), body.alias("cigar"), a["query_len"].alias("ref_len"), a["ref_len"].alias("query_len"))


def status(alignment: Column, of: dict[str, Column] | None = None) -> Column:
    """The column ``of`` names for the alignment's status (Some, Unmapped, Overflowed), else null: what to do in each case."""
    out = F.lit(None)
    for k, v in (of or {}).items():
        out = F.when(alignment["status"] == k, v).otherwise(out)
    return out


def overflowing(alignment: Column, least: int = -(1 << 31), most: int = (1 << 31) - 1) -> Column:
    """The alignment with the status Overflowed, and nothing else, where its score does not fit the range."""
    fits = alignment["score"].isNull() | alignment["score"].between(least, most)
    kept = [F.when(fits, alignment[c.split()[0]]).alias(c.split()[0]) for c in ALIGNMENT.split(", ")[1:-2]]
    return F.struct(F.when(fits, alignment["status"]).otherwise("Overflowed").alias("status"), *kept, alignment["ref_len"].alias("ref_len"), alignment["query_len"].alias("query_len"))


def parse_matrix(text: str) -> Weights:
    """A weight matrix from text: ``#`` comments, a header of letters, rows of numbers with or without a label."""
    lines = [x for x in (y.strip() for y in text.splitlines()) if x and not x.startswith("#")]
    alphabet = "".join(lines[0].split())
    rows = []
    for i, line in enumerate(lines[1:]):
        parts = line.split()
        if len(parts) == len(alphabet) + 1:
            if parts[0] != alphabet[i]:
                raise ValueError(f"row {i} is labelled {parts[0]}")
            parts = parts[1:]
        if len(parts) != len(alphabet):
            raise ValueError(f"row {i} has {len(parts)} numbers")
        rows.append(tuple(map(int, parts)))
    if len(rows) != len(alphabet):
        raise ValueError("the matrix is not square")
    return Weights(alphabet, tuple(rows), "X" if "X" in alphabet else alphabet[0])


_CIGLET = re.compile("([0-9]+)([MIDNSHP=X])")


@lru_cache(maxsize=4096)
def _short_ciglets(cigar: str) -> tuple[tuple[int, str], ...]:
    return tuple((int(n), op) for n, op in _CIGLET.findall(cigar))


def ciglets(cigar: str) -> list[tuple[int, str]]:
    """The operations; those of short strings are remembered, as many alignments have the same."""
    return list(_short_ciglets(cigar)) if len(cigar) <= 128 else [(int(n), op) for n, op in _CIGLET.findall(cigar)]


def sliced(cigar: str, ref_start: int, ref_end: int, query_len: int, low: int, high: int) -> tuple[int, int, str] | None:
    """(query_start, query_end, cigar) of an alignment cut to the reference range, what is left of the query clipped.

    None where the range is not all aligned; an empty range inside the alignment clips the whole query.
    """
    if low < ref_start:
        return None
    ops: list[tuple[int, str]] = []
    ref, query, begin = ref_start, 0, None
    for n, op in ciglets(cigar):
        in_ref, in_query = op in "MDN=X", op in "MIS=X"
        end = ref + n * in_ref
        if begin is None and end > low:
            skipped = max(low - ref, 0)
            begin = query + skipped * in_query
            n, ref, query = n - skipped, ref + skipped, begin
        if begin is None:
            ref, query = end, query + n * in_query
            continue
        taken = n if not in_ref else min(n, max(high - ref, 0))
        ops.append((taken, op))
        ref, query = ref + taken * in_ref, query + taken * in_query
        if ref >= high:
            break
    if begin is None:
        return (0, 0, run_lengths([(query_len, "S")])) if low == high and ref_start <= low <= ref_end else None
    if ref < high:
        return None
    return begin, query, run_lengths([(begin, "S"), *ops, (query_len - query, "S")])


def slice_to_ref_range(alignment: Column, low: int | Column, high: int | Column) -> Column:
    """The alignment cut to a range of the reference; null where it does not cover the range. Score and lengths stay."""
    ship()

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.DataFrame, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        rows = []
        for r, x, y in zip(a.itertuples(index=False), low, high, strict=True):
            cut = None if pd.isna(r.ref_start) or r.cigar is None or pd.isna(x) or pd.isna(y) else sliced(r.cigar, int(r.ref_start), int(r.ref_end), int(r.query_len), int(x), int(y))
            rows.append((None,) * 9 if cut is None else (r.status, r.score, int(x), int(y), cut[0], cut[1], cut[2], r.ref_len, r.query_len))
        return _frame(rows)

    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return run(alignment, as_long(low), as_long(high))


def verbose(ref: str, query: str, cigar: str, ref_start: int) -> str:
    """The operations with M told apart as ``=`` and ``X`` by equal letters."""
    out: list[tuple[int, str]] = []
    r, q = ref_start, 0
    for n, op in ciglets(cigar):
        if op == "M":
            x, y = ref[r : r + n], query[q : q + n]
            if len(x) != len(y):
                raise ValueError("the operations run past the end of a sequence")
            out += [(sum(1 for _ in same), "=" if equal else "X") for equal, same in groupby(map(eq, x, y))]
        else:
            out.append((n, op))
        r, q = r + n * (op in "MDN=X"), q + n * (op in "MIS=X")
    return run_lengths(out)


def verbose_matching(ref: Column, query: Column, alignment: Column) -> Column:
    """``verbose`` of the aligned columns."""
    ship()

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([verbose(x, y, z, int(s)) if isinstance(z, str) else None for x, y, z, s in zip(a, b, c, start, strict=True)], dtype=object)

    return run(ref, query, alignment["cigar"], alignment["ref_start"])


def read_matrix(name: str, folder: str) -> Weights:
    """A named matrix from a folder of matrix files: the name's case, blanks, dashes and underscores do not matter."""
    from pathlib import Path

    plain = lambda x: re.sub(r"[\s_-]", "", x).lower()
    for path in sorted(Path(folder).iterdir()):
        if plain(path.stem if path.suffix.lower() in (".txt", ".mat") else path.name) == plain(name):
            return parse_matrix(path.read_text())
    raise ValueError(f"no matrix is called {name}")
