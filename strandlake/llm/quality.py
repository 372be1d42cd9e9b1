"""Quality scores from a generalised additive model with pairwise interactions.

Each text gives a row of features (``FEATURES``). Features are cut into quantile bins; trees of two splits at most are
boosted in turn, one feature at a time and all features in a cycle, each step adding its leaves to that feature's lookup
table; then the pairs of features whose residuals gain most get tables of their own, boosted by one split a side. A score
is the sum of the looked-up values, added for a whole batch at once.

The model is fitted on the driver from at most ``max_rows`` labelled rows, chosen by a hash of their ids; scores are
computed for every whole text where it lies.

Cases: null and empty texts have features of zeros and get a score like any other; without labelled rows of both kinds
every score is the share of good rows (0.5 without any); rows that repeat an id are scored each, and one of them is learnt
from, the one of the least hash; labels that repeat an id count as the greatest; equal features get equal scores; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._labels import first_by_hash, fold, labelled, one_a_document
from strandlake.llm._text import SPACED, Words, mix, filter_texts, over_texts, quoted, rolled, same_row

MAX_ROWS, BINS, PAIR_BINS, CYCLES, PAIRS, PAIR_CYCLES = 20_000, 64, 8, 120, 6, 60
FEATURES = ("log_words", "word_length", "upper", "symbols", "exclamations", "pipes", "digits", "punctuation", "non_ascii", "lines", "distinct_words", "repeated_windows", "capital_words", "common_share", "long_words")

#: Kinds of bytes that are counted.
LOWER, UPPER, DIGIT, SYMBOL, EXCLAMATION, PIPE, POINT, LINE, WIDE, PLAIN = range(10)
_KIND = np.full(256, PLAIN, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = LOWER, UPPER, DIGIT, WIDE
for _chars, _k in ((b"#*$%&<>", SYMBOL), (b"!", EXCLAMATION), (b"|", PIPE), (b".,;:?'\"()-", POINT), (b"\n", LINE)):
    _KIND[list(_chars)] = _k


def distinct_in_rows(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of distinct values, and the count of its most frequent one."""
    key, at, n = np.unique(mix(h ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], n)
    return np.bincount(row[at], minlength=rows), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    words = Words(texts, SPACED)
    rows = len(words.count)
    size = np.diff(words.offsets)
    of = np.repeat(np.arange(rows, dtype=np.int64), size)
    kinds = np.bincount(of * 10 + _KIND[words.raw], minlength=rows * 10).reshape(rows, 10).astype(np.float64)
    n = np.maximum(words.count, 1)
    length = np.maximum(size, 1)
    letters = np.maximum(kinds[:, LOWER] + kinds[:, UPPER], 1)
    distinct, most = distinct_in_rows(words.hash, words.row, rows)
    inside = same_row(words.row, 3)
    grams, gram_row = rolled(words.hash, 3)[inside], words.row[: len(inside)][inside]
    windows = np.bincount(gram_row, minlength=rows)
    different, _ = distinct_in_rows(grams, gram_row, rows)
    width = words.end - words.start
    lead = _KIND[words.raw[words.start]] if len(words.start) else np.zeros(0, np.uint8)
    by_row = lambda x: np.bincount(words.row, x, minlength=rows)
    return np.column_stack(
        [
            np.log1p(words.count),
            by_row(width) / n,
            kinds[:, UPPER] / letters,
            kinds[:, SYMBOL] / length,
            kinds[:, EXCLAMATION] / length,
            kinds[:, PIPE] / length,
            kinds[:, DIGIT] / length,
            kinds[:, POINT] / length,
            kinds[:, WIDE] / length,
            kinds[:, LINE] / n,
            distinct / n,
            (windows - different) / np.maximum(windows, 1),
            by_row(lead == UPPER) / n,
            most / n,
            by_row(width > 20) / n,
        ]
    )


class Model:
    """Bin edges and lookup tables; ``pairs`` are tables over two features' coarser bins."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def best_split(g: np.ndarray, h: np.ndarray, least: float = 5.0) -> tuple[float, int]:
    """The gain and the place of the best cut of neighbouring bins in two."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    i = int(gain.argmax())
    return float(gain[i]), i + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value for each bin by a tree of at most two splits."""
    out = np.zeros(len(g))
    gain, at = best_split(g, h)
    parts = [(0, at), (at, len(g))] if gain > 0 else [(0, len(g))]
    if gain > 0:
        (gain_l, l), (gain_r, r) = (best_split(g[a:b], h[a:b]) for a, b in parts)
        if max(gain_l, gain_r) > 0:
            parts = [(0, l), (l, at), (at, len(g))] if gain_l >= gain_r else [(0, at), (at, at + r), (at + r, len(g))]
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, rate: float = 0.1, cycles: int = CYCLES, pairs: int = PAIRS, pair_cycles: int = PAIR_CYCLES) -> Model:
    """x: rows of features; y: 0 or 1."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges, model.coarse = [cut_points(x[:, j], BINS) for j in range(k)], [cut_points(x[:, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)
    slopes = lambda: ((p := 1 / (1 + np.exp(-f))) - y, np.maximum(p * (1 - p), 1e-6))
    for _ in range(cycles):
        for j in range(k):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            f += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[a] * shape[b] + coarse[b]
        return tuple(np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (g, h))

    def crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best split a side: four leaves."""
        best, out = 0.0, np.zeros(g.shape)
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        for i in range(g.shape[0] - 1):
            gl, hl = cg[i, :-1], ch[i, :-1]
            leaves = [(gl, hl), (cg[i, -1] - gl, ch[i, -1] - hl), (cg[-1, :-1] - gl, ch[-1, :-1] - hl), (cg[-1, -1] - cg[i, -1] - cg[-1, :-1] + gl, ch[-1, -1] - ch[i, -1] - ch[-1, :-1] + hl)]
            gain = sum(a**2 / (b + 1) for a, b in leaves)
            gain[np.min([b for _, b in leaves], 0) < 2] = 0
            j = int(gain.argmax())
            if gain[j] > best:
                best = float(gain[j])
                v = [-a[j] / (b[j] + 1) for a, b in leaves]
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return best, out

    ranked = sorted(((crossed(*sums(a, b))[0], a, b) for a, b in combinations(range(k), 2) if shape[a] > 1 and shape[b] > 1), reverse=True)
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for gain, a, b in ranked[:pairs] if gain > 0]
    for _ in range(pair_cycles):
        for a, b, table in model.pairs:
            step = rate * crossed(*sums(a, b))[1]
            table += step
            f += step[coarse[a], coarse[b]]
    return model


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS) -> Model:
    """The model from all folds but ``held_out``."""
    known = labelled(labels, doc_id, label).where(fold("doc_id", folds) != held_out)
    picked = first_by_hash(known, max_rows)  # bounded by max_rows
    text_ = F.col(quoted(text))
    rows = documents.select(F.col(quoted(doc_id)).alias("doc_id"), text_.alias("text"), F.xxhash64(F.coalesce(text_, F.lit(""))).alias("tag")).join(F.broadcast(picked), "doc_id")

    def work():
        return lambda batch: {"doc_id": batch["doc_id"], "tag": batch["tag"], "y": batch["y"], "x": list(features(batch["text"]))}

    found = one_a_document(over_texts(rows, {k: k for k in ("doc_id", "tag", "text", "y")}, "doc_id bigint, tag bigint, y int, x array<double>", work), "y", "x")
    kept = sorted(found.collect())  # max_rows rows of len(FEATURES) numbers at most
    return fit(np.array([r["x"] for r in kept]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in kept], float))


def score(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def work():
        return lambda batch: {"doc_id": batch["doc_id"], "score": held.value.score(features(batch["text"]))}

    return over_texts(documents, {"doc_id": doc_id, "text": text}, "doc_id bigint, score double", work)


def keep(documents: DataFrame, model: Model, threshold: float, *, text: str = "text") -> DataFrame:
    """The documents of at least this score, with all columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    return filter_texts(documents, text, lambda: lambda texts: held.value.score(features(texts)) >= threshold)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model that has seen no label of fold 2."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(documents, train(documents, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
