"""Bytes of whole Arrow batches at once, for what walks over every letter of long texts.

As expressions such a walk costs tens of nanoseconds a letter: regular expressions, maps of one-letter strings and lambdas
are worked out letter by letter. Here a task's batch is one array of bytes and a few numpy passes over it. Spark deals the rows.
The functions are columns, but cannot stand inside a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alphabets import ByteMap, genetic_code
from strandlake.shipping import ship

#: Bytes of an Arrow batch, in place of Spark's default of 64 MB: a batch meets all maps of a query together.
BATCH_BYTES = "8m"
#: Bytes of one pass: what is made of them in between is a few times that.
CHUNK = 1 << 22


def prepared() -> None:
    """The package on the executors, and Arrow batches of a size that small executors hold."""
    ship()
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(key) in ("64m", "67108864", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)


def _letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends; null texts are empty."""
    text = text.cast(pa.large_string()).fill_null("")
    size = len(text)
    at = np.frombuffer(text.buffers()[1], np.int64, size + 1, text.offset * 8) if size else np.zeros(1, np.int64)
    data = text.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return letters, at - at[0]


def _texts(letters: np.ndarray, at: np.ndarray, null: pa.Array) -> pa.Array:
    """The texts of bytes and places; null where the mask says so."""
    made = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(letters)))
    return pc.if_else(null, pa.scalar(None, pa.large_string()), made).cast(pa.string())


def _cut(text: pa.Array):
    """The batch in parts of whole texts, of about ``CHUNK`` bytes."""
    at, n = 0, len(text)
    sizes = np.cumsum(np.asarray(pc.binary_length(text).fill_null(0), np.int64)) if n else np.zeros(0, np.int64)
    while at < n:
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")), at + 1)
        yield text.slice(at, end - at)
        at = end


def _column(made: Callable[[pa.Array], pa.Array], kind: str, result: pa.DataType) -> Callable[[Column], Column]:
    def run(text: pa.Array) -> pa.Array:
        parts = [made(x) for x in _cut(text)]
        return pa.concat_arrays(parts) if parts else pa.array([], result)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


# Maps of letters --------------------------------------------------------------------------------------------------------------


@lru_cache
def _mapped(default: str | None, pairs: tuple[tuple[str, str], ...]):
    table, kept = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if default is not None:  # a character of several bytes is one letter: its first byte becomes the default, the others go
        table[:], kept[:] = ord(default or " "), default != ""
        kept[128:192] = False
    for letter, to in pairs:
        table[ord(letter)], kept[ord(letter)] = ord(to or " "), to != ""

    def made(text: pa.Array) -> pa.Array:
        letters, at = _letters(text)
        out = table[letters]
        if not kept.all() and not (stay := kept[letters]).all():
            out, at = out[stay], np.concatenate([[0], np.cumsum(stay)])[at]
        return _texts(out, at, text.is_null())

    return _column(made, "string", pa.string())


def mapped(col: Column, by: ByteMap) -> Column:
    """As ``by.apply``."""
    used = [*by.pairs, *by.pairs.values(), by.default or ""]
    if any(len(c) > 1 or not c.isascii() for c in used):
        return by.apply(col)
    prepared()
    return _mapped(by.default, tuple(by.pairs.items()))(col)


# Quality scores ---------------------------------------------------------------------------------------------------------------

_STATISTICS = [("min", pa.int32()), ("max", pa.int32()), ("median", pa.float32()), ("geometric_mean", pa.float32()), ("arithmetic_mean", pa.float32())]


def _statistics(q: np.ndarray) -> tuple[float, ...]:
    """Of scores; from a count of each, so that a long text costs one pass over its bytes."""
    counts = np.bincount(q)
    seen = counts.nonzero()[0]
    n, upto, scores = counts[seen], counts[seen].cumsum(), seen - 33
    low, high = (scores[np.searchsorted(upto, k, "right")] for k in ((len(q) - 1) // 2, len(q) // 2))
    return scores[0], scores[-1], (low + high) / 2, (n @ scores) / len(q), -10 * np.log10((n @ 10.0 ** (-scores / 10.0)) / len(q))


def _scored(text: pa.Array) -> pa.Array:
    letters, at = _letters(text)
    rows = []
    for begin, end in zip(at[:-1], at[1:], strict=True):
        q = letters[begin:end]
        if end > begin and q.max() > 127:
            q = np.frombuffer(q.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        rows.append(_statistics(q) if end > begin else (0,) * len(_STATISTICS))
    columns = [pa.array(np.asarray(x).astype(t.to_pandas_dtype())) for x, (_, t) in zip(zip(*rows, strict=True), _STATISTICS, strict=True)]
    return pa.StructArray.from_arrays(columns, [n for n, _ in _STATISTICS], mask=pa.array(np.diff(at) == 0))


@lru_cache
def _scores():
    return _column(_scored, "min int, max int, median float, geometric_mean float, arithmetic_mean float", pa.struct(_STATISTICS))


def score_statistics(col: Column) -> Column:
    """(min, max, median, geometric_mean, arithmetic_mean) of the scores of a quality string; null without letters."""
    prepared()
    return _scores()(col)


# Translation ------------------------------------------------------------------------------------------------------------------

_LETTERS = "ACGTRYSWKMBDHVNU-."


def _residues(partial: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The place of each byte in the code's letters (0: unknown), and the residues by three places."""
    place = np.zeros(256, np.uint16)
    for i, c in enumerate(_LETTERS, 1):
        place[ord(c)] = i
    table = np.full(32 ** 3, ord("X"), np.uint8)
    numbers = {c: i for i, c in enumerate(_LETTERS, 1)}
    for codon, residue in genetic_code().items():
        a, b, c = (numbers[x] for x in codon)
        table[a << 10 | b << 5 | c] = ord(residue)
    if partial is not None:
        gaps = np.isin(np.arange(32), [numbers["-"], numbers["."]]).astype(int)
        count = gaps[:, None, None] + gaps[None, :, None] + gaps[None, None, :]
        table[((count == 1) | (count == 2)).ravel()] = ord(partial)
    return place, table


@lru_cache
def _translated(partial: str | None, step: int):
    place, table = _residues(partial)

    def made(text: pa.Array) -> pa.Array:
        letters, at = _letters(text)
        if (letters > 127).any():  # a character of several bytes is one unknown letter
            kept = (letters < 128) | (letters > 191)
            letters, at = letters[kept], np.concatenate([[0], np.cumsum(kept)])[at]
        p, n = place[letters], np.diff(at)
        size = n // 3 if step == 3 else np.maximum(n - 2, 0)
        end = np.concatenate([[0], np.cumsum(size)])
        first = np.repeat(at[:-1] - step * end[:-1], size) + step * np.arange(end[-1])
        return _texts(table[p[first] << 10 | p[first + 1] << 5 | p[first + 2]], end, text.is_null())

    return _column(made, "string", pa.string())


def residues(col: Column, partial: str | None, step: int) -> Column:
    """The residues of full codons at every ``step``-th letter (3: in frame 0, 1: in all frames) of a sequence in upper case."""
    prepared()
    return _translated(partial, step)(col)
