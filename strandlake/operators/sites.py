"""Per-site counts of aligned rows by key, and a running consensus of a stream.

Sites are counted in blocks of ``BLOCK``: each task turns its rows into arrays of counts, one for each key and block that it has met, and
these are added element by element. So what travels is a row for each key, block and task, not one for each base, and a row of
millions of sites is many blocks, none of which is held by one task alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandlake.functions.composition import _SLOT_CHARS, SLOTS, plurality_acgtn
from strandlake.shipping import ship

BLOCK = 1024
#: Counts that a task holds before it sends them on (8 slots a site).
HELD = 4_000_000

#: The slot of each byte.
_SLOT = np.full(256, len(SLOTS) - 1, np.uint8)
for _i, _name in enumerate(SLOTS[:-1]):
    _SLOT[np.frombuffer(_SLOT_CHARS[_name].replace("\\", "").encode(), np.uint8)] = _i


def block_counts(df: DataFrame, seq: str, key: str, block: int = BLOCK) -> DataFrame:
    """(key, block, counts): the eight counts of each site of a block, one after another; null sequences have no sites.

    Sequences are ASCII; a byte of any other letter counts as a site by itself.
    """
    ship(df.sparkSession)
    kind = df.select(F.col(key).alias("key")).schema["key"].dataType

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def batch_of() -> pa.RecordBatch:
            keys = pa.array([k for k, _ in held], key_type)
            out = pa.RecordBatch.from_arrays([keys, pa.array([b for _, b in held], pa.int64()), pa.array([c.ravel() for c in held.values()], pa.list_(pa.int64()))], names=["key", "block", "counts"])
            held.clear()
            return out

        for batch in batches:
            key_type = batch["key"].type
            for k, s in zip(batch["key"].to_pylist(), batch["seq"], strict=True):
                if not s.is_valid:
                    continue
                slots = _SLOT[np.frombuffer(s.as_buffer(), np.uint8)]
                for at in range(0, len(slots), block):
                    part = slots[at : at + block]
                    counts = held.setdefault((k, at // block), np.zeros((block, len(SLOTS)), np.int64))
                    counts[np.arange(len(part)), part] += 1
                    if len(held) * block * len(SLOTS) >= HELD:
                        yield batch_of()
        if held:
            yield batch_of()

    schema = StructType([StructField("key", kind), StructField("block", LongType()), StructField("counts", ArrayType(LongType()))])
    sent = df.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInArrow(partial, schema)

    def added(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, name = None, None
        for part in groups:
            for k, b, counts in zip(part["key"], part["block"], part["counts"], strict=True):
                name = (k, b)
                total = np.array(counts, np.int64) if total is None else total + np.asarray(counts)
        yield pd.DataFrame({"key": [name[0]], "block": [name[1]], "counts": [total]})

    return sent.groupBy("key", "block").applyInPandas(added, schema)


def site_counts(df: DataFrame, seq: str, key: str, block: int = BLOCK) -> DataFrame:
    """(key, pos, eight counts) of every site that a row of the key has."""
    blocks = block_counts(df, seq, key, block)
    width = len(SLOTS)
    each = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.struct((F.col("block") * block + i).alias("pos"), *[F.get("counts", i * width + j).alias(s) for j, s in enumerate(SLOTS)]))
    sites = blocks.select("key", F.inline(each))
    some = sum((F.col(s) for s in SLOTS[1:]), F.col(SLOTS[0])) > 0
    return sites.where(some).select(F.col("key").alias(key), "pos", *SLOTS)


def consensus(df: DataFrame, seq: str, key: str, block: int = BLOCK) -> DataFrame:
    """(key, block, bases): the plurality of each site of each block, as text; blocks in their order make the consensus."""
    sites = site_counts(df, seq, key, block).select(key, "pos", plurality_acgtn(F.struct(*[F.col(s) for s in SLOTS])).alias("base"))
    placed = sites.groupBy(key, F.floor(F.col("pos") / block).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return placed.select(key, "block", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("bases"))


class Running(StatefulProcessor):
    """Holds a key's and block's counts; each batch adds to them and gives the new ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = np.array(self.counts.get()[0], np.int64) if self.counts.exists() else None
        for part in rows:
            for counts in part["counts"]:
                total = np.array(counts, np.int64) if total is None else total + np.asarray(counts)
        self.counts.update((total.tolist(),))
        yield pd.DataFrame({"key": [key[0]], "block": [key[1]], "counts": [total.tolist()]})

    def close(self) -> None:
        pass


def running_counts(stream: DataFrame, seq: str, key: str, block: int = BLOCK) -> DataFrame:
    """The counts of each key and block that a batch of a stream has changed, for update mode.

    A stream's state is in the RocksDB store, which ``spark.sql.streaming.stateStore.providerClass`` must name.
    """
    ship(stream.sparkSession)
    kind = stream.select(F.col(key).alias("key")).schema["key"].dataType
    schema = StructType([StructField("key", kind), StructField("block", LongType()), StructField("counts", ArrayType(LongType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blocks, counts = [], [], []
            for k, s in zip(batch["key"].to_pylist(), batch["seq"], strict=True):
                slots = _SLOT[np.frombuffer(s.as_buffer(), np.uint8)] if s.is_valid else np.zeros(0, np.uint8)
                for at in range(0, len(slots), block):
                    part = slots[at : at + block]
                    one = np.zeros((block, len(SLOTS)), np.int64)
                    one[np.arange(len(part)), part] = 1
                    keys.append(k)
                    blocks.append(at // block)
                    counts.append(one.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch["key"].type), pa.array(blocks, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], names=["key", "block", "counts"])

    sent = stream.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInArrow(rows, schema)
    return sent.groupBy("key", "block").transformWithStateInPandas(Running(), schema, "Update", "None")
