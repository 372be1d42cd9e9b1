"""Vectorised word scanning shared by the Arrow-batched operators.

A chunk of rows is handled as one byte array: words, their 64-bit hashes and their rows come from array operations, so no
Python code runs per word. A chunk holds ``CHUNK`` bytes of text, or one longer row, which is hashed in blocks: memory is
about ten times the bytes of the longest text. Arrow batches that Spark sends are bounded by ``BATCH_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.shipping import ship

CHUNK = 1 << 17
#: Sessions that keep Spark's default bound of an Arrow batch (64 MB) get this one.
BATCH_BYTES = "8m"

# The C library's allocator gives freed memory back beyond twice the largest block freed so far. Without a block of some
# size every chunk's arrays would be mapped anew, which takes longer than filling them.
np.empty(8 << 20, np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []
#: A random 64-bit value for each byte.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte itself, or 0 where it separates words (the ranges are inclusive)."""
    table = np.arange(256, dtype=np.uint8)
    for a, b in ranges:
        table[a : b + 1] = 0
    return table


def lowered(table: np.ndarray) -> np.ndarray:
    """The table with A-Z mapped to a-z."""
    out = table.copy()
    out[65:91] = np.arange(97, 123)
    return out


#: Words of everything but ASCII white space.
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
#: The same in lower case.
SPACED_LOWER = lowered(SPACED)
#: Words of letters, digits and non-ASCII characters, in lower case.
ALNUM_LOWER = lowered(separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))
# NUL separates nothing in SPACED; it stands there as another value.
SPACED[0] = SPACED_LOWER[0] = 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, x, np.uint64)]) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]``, the same wherever the span stands. Starts and ends ascend.

    values: of 64 bits, or codes that ``table`` has such values for.
    """
    power, inverse = _power_tables()
    of = (lambda v: v) if table is None else (lambda v: table[v])
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(int(np.searchsorted(end, a + CHUNK, "right")), i + 1)
        b = int(end[j - 1])
        if b - a > CHUNK:  # one long span, a block at a time
            total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for x in range(a, b, CHUNK):
                v = of(values[x : min(x + CHUNK, b)])
                total += (v * power[: len(v)]).sum(dtype=np.uint64) * scale
                scale *= power[CHUNK]
            out[i] = total[0]
        else:
            v = of(values[a:b])
            sums = np.empty(len(v) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(v * power[: len(v)], out=sums[1:])
            s = start[i:j] - a
            out[i:j] = (sums[end[i:j] - a] - sums[s]) * inverse[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


class Words:
    """The words of a chunk of rows.

    data: the mapped bytes; start, end: byte ranges of words; first: for each row the number of its first word, and the
    number of words; row: each word's row; hash: each word's hash, taken when it is first asked for.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray) -> None:
        offsets, self.raw = text_bytes(texts)
        data = table[self.raw]
        word = data != 0
        self.data, self.offsets = data, offsets
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            start_of = word & (~before | begins[:n])
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = word[1:]
            end_of = word & (~after | begins[1:])
        else:
            start_of = end_of = word
        self.start = np.flatnonzero(start_of)
        self.end = np.flatnonzero(end_of) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts)), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end, _BYTES)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and which of these stay in one row."""
        return rolled(self.hash, k), same_row(self.row, k)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out)


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    n = max(len(row) - k + 1, 0)
    return row[:n] == row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (from 0) and bytes of a string array, null being empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with up to ``limit`` bytes of text, or one row."""
    offsets, _ = text_bytes(batch[column])
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches of a size that small executors hold."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "67108864", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)


def over_texts(df: DataFrame, columns: dict[str, str], schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]]) -> DataFrame:
    """mapInArrow over chunks: ``work()`` is called once a task and gives the function of a chunk.

    columns: the input's columns by the names that the function uses; "text" must be one of them.
    """
    prepare(df.sparkSession)
    fields = arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            for part in chunks(batch, "text"):
                out = f(part)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], t) for k, t in fields], names=[k for k, _ in fields])
            batch = part = out = None
            pa.default_memory_pool().release_unused()

    return df.select(*[F.col(quoted(v)).alias(k) for k, v in columns.items()]).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, work: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows that the function of a task keeps, judged by their texts chunk by chunk, with all columns."""
    prepare(df.sparkSession)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            part = kept = None
            for part in chunks(named, f"c{place}"):
                kept = part.filter(pa.array(f(part[f"c{place}"])))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=batch.schema)
            batch = named = part = kept = None
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column is called so."""
    out, used = [], {c.lower() for c in taken}
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] values), start[1], ..."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)
