"""Packing of token sequences by the sum-of-squares rule.

A text becomes token ids with an end mark; those longer than a sequence are cut into pieces, all full but the first. Full
pieces are sequences of their own. The others are dealt at random into groups of about ``group_pieces`` and packed there,
longest first: with N(g) open sequences of gap g, a piece goes where the sum of all N(g) squared becomes least (a new
sequence counts as a gap of the whole capacity; of equal places the fullest is taken). Sequences left with no gap are
closed. The pieces of all others are gathered, a small part of the rows, and dealt again into fewer groups, until one is
left or regrouping closes less than three tenths (as where long pieces lack short ones); there the last open pieces are
placed by best fit. So each task holds a bounded number of pieces whatever the input, and only last groups leave gaps.

Cases: null text is empty and gives its end mark alone; rows that repeat a doc_id are packed each; no rows give no rows; of equal
lengths the order of rows decides; other columns of pieces stay, but for sequence_id and offset, which are refused.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandlake.llm._spark import stored
from strandlake.llm._text import free, over_texts
from strandlake.llm._tokens import Vocabulary
from strandlake.shipping import ship

CAPACITY, END, GROUP = 1024, 2, 16_384


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(documents: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    tokenizer: a file's path, or the name of a public tokenizer file; it is read on the driver and sent to the executors.
    """

    held = documents.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)))

    def work():
        model = held.value.ids()

        def f(batch: pa.RecordBatch) -> dict:
            flat, size = model(batch["text"])
            total = size + 1
            ends = np.cumsum(total)
            ids = np.full(int(total.sum()), end_id, "<u4")
            keep = np.ones(len(ids), bool)
            keep[ends - 1] = False
            ids[keep] = flat
            n = (total - 1) // capacity + 1
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = (total - (n - 1) * capacity)[row]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            at = (ends - total)[row] + start
            out = {"doc_id": batch["doc_id"].take(pa.array(row)), "piece": piece, "start": start, "length": length, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(ids.astype(np.int32)))
            return out

        return f

    return over_texts(documents, {"doc_id": doc_id, "text": text}, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids, work)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], list[list[int]]]:
    """Sequences without a gap, and the others, as lists of indices. All lengths are from 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)
    places: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    closed: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap, bin_ = capacity, None
        if s < capacity:
            here = count[s:capacity]
            # the change of the sum: one open sequence fewer of gap g, one more of gap g - s; no gap counts nothing
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            j = int(change.argmin())
            if change[j] < 2 * count[capacity - s] + 1:
                gap = s + j
                count[gap] -= 1
                bin_ = places[gap].pop()
        bin_ = [*(bin_ or []), i]
        if gap == s:
            closed.append(bin_)
        else:
            count[gap - s] += 1
            places[gap - s].append(bin_)
    return closed, [b for at in places for b in at]


def best_fit(lengths: np.ndarray, members: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that can take it."""
    count = np.zeros(capacity + 1, np.int64)
    places: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for i in sorted(members, key=lambda i: -lengths[i]):
        s = int(lengths[i])
        fits = np.flatnonzero(count[s:])
        gap, bin_ = (s + int(fits[0]), None) if len(fits) else (capacity, [])
        if bin_ is None:
            count[gap] -= 1
            bin_ = places[gap].pop()
        bin_.append(i)
        count[gap - s] += 1
        places[gap - s].append(bin_)
    return [b for at in places for b in at]


def placing(level: int, last: bool, capacity: int, group: str):
    """The function that packs one group, whose number is in the column ``group``."""

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        lengths = batch["length"].to_numpy()
        closed, open_ = sum_of_squares(lengths, capacity)
        left = [i for b in open_ for i in b]
        if last:
            closed, left = closed + best_fit(lengths, left, capacity), []
        order = [i for b in closed for i in b]
        size = np.array([len(b) for b in closed], np.int64)
        number = np.repeat(np.arange(len(closed)), size)
        used = lengths[order]
        at = np.cumsum(used) - used
        offset = at - np.repeat(at[np.cumsum(size) - size], size) if len(order) else at
        out = batch.iloc[order + left].drop(columns=group)
        base = (level << 56) + (int(batch[group].iloc[0]) << 24)
        out["sequence_id"] = pd.array([*(base + number), *[None] * len(left)], "Int64")
        out["offset"] = pd.array([*offset, *[None] * len(left)], "Int64")
        return out

    return place


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP) -> DataFrame:
    """The pieces (a column ``length`` from 1 to capacity, any others) with their sequence_id and offset, which the pieces must not have yet."""
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("the pieces have a column sequence_id or offset")
    ship(pieces.sparkSession)
    (group,) = free(pieces.columns, "group_")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    pieces = stored(pieces)  # tokens are counted once; from here on rows keep their places
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    done, level, n, before = [full], 0, rest.count(), float("inf")
    while n:
        groups = -(-n // group_pieces)
        last = groups == 1 or n > 0.7 * before

        dealt = rest.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = stored(dealt.groupBy(group).applyInPandas(placing(level, last, capacity, group), schema))
        done.append(packed.where("sequence_id is not null"))
        rest = packed.where("sequence_id is null").drop("sequence_id", "offset")
        level, n, before = level + 1, 0 if last else rest.count(), n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def op3_pack(spark, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 1024 tokens."""
    return pack(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")))
