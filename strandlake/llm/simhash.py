"""Near-duplicate documents by SimHash fingerprints, linked through segment popcounts.

A fingerprint has 64 bits: bit j is set where more than half of the XXH64 hashes of a text's shingles (3 lower-case words,
repeats included; a shorter text is one shingle) have it. Fingerprints that differ in at most ``distance`` bits are linked.

The steps, none of which meets a group of copies in one task or emits its pairs:
1. equal fingerprints become one (an aggregation with map-side combine);
2. each fingerprint is mapped to its vector of bit counts, one for each segment of ``width`` bits. A differing bit changes one
   count by one, so the vectors' Manhattan distance is at most the number of differing bits. The vectors live on a unit grid:
   each fingerprint is filed in the cells within half the distance of its own (1 + 2 * 16 of them for 16 segments and two
   bits), and two vectors within the distance share one, as there is a point of the grid between them;
3. members of a cell are joined and verified by their bits;
4. cells of more than ``CELL`` members, as of a large group of near copies, are not joined: their members are filed under all
   fingerprints within half the distance in bits, and each such group is linked to its least member. What shares a group is
   within the distance without a check, and pairs within the distance share one, so this is exact as well; rows are 65 a
   member, whatever the group's size.
The links go through ``components``. Work is within ``CELL`` candidates for each filed row.

Cases: null and empty texts, and texts of white space, have the fingerprint zero, which is linked like any other; rows that
repeat a doc_id with one text count once, with several texts the id joins their fingerprints; a null doc_id is linked with
nothing and has a null component; equal ids have equal components; very long texts are hashed in blocks; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import SPACED_LOWER, Words, lowered, over_texts
from strandlake.llm.components import components

SHINGLE, SEED, DISTANCE, WIDTH = 3, 42, 2, 4
#: Members of a cell that are joined with each other.
CELL = 64
#: Heavy cells are broadcast up to so many, else joined.
BROADCAST_CELLS = 1_000_000
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15

_LOWER = lowered(np.arange(256, dtype=np.uint8))


def shingle_spans(words: Words, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space, begins and ends of all shingles there, and the number of shingles of each row."""
    n = len(words.data)
    after = words.end[words.end < n]
    after = after[words.data[after] == 0]
    low, keep = _LOWER[words.raw], words.data != 0
    low[after], keep[after] = 0x20, True
    place = np.cumsum(keep)
    start, end = (place[words.start] - 1, place[words.end - 1]) if n else (words.start, words.end)
    size = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    row = np.repeat(np.arange(len(size)), size)
    first = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    last = first + np.minimum(words.count[row], k) - 1
    return low[keep].tobytes(), start[first], end[last], size


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's hashes, which stand one row after the other."""
    row = np.repeat(np.arange(len(size)), size)
    counts = np.zeros((len(size), 64), np.int64)
    for a in range(0, len(hashes), BLOCK):
        part, of = hashes[a : a + BLOCK], row[a : a + BLOCK]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[of[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint) of each row, the fingerprint as a signed 64-bit number."""

    def work():
        h = xxhash.xxh64_intdigest

        def f(batch: pa.RecordBatch) -> dict:
            joined, start, end, size = shingle_spans(Words(batch["text"], SPACED_LOWER), shingle)
            hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
            return {"doc_id": batch["doc_id"], "fingerprint": majority(hashes, size).view(np.int64)}

        return f

    return over_texts(documents, {"doc_id": doc_id, "text": text}, "doc_id bigint, fingerprint bigint", work)


def popcounts(fingerprint: Column, width: int = WIDTH) -> Column:
    """The bit counts of the segments, each in the bits of its segment."""
    if width not in (4, 8, 16):
        raise ValueError("segments have 4, 8 or 16 bits")
    out = F.lit(0).cast("bigint")
    for at in range(0, 64, width):
        count = F.bit_count(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        out = out.bitwiseOR(F.shiftleft(count.cast("bigint"), at))
    return out


def nearby(vector: Column, radius: int, width: int = WIDTH) -> Column:
    """All vectors of bit counts within a Manhattan distance, the vector itself among them."""
    cells = F.array(vector)
    for i in range(radius):
        moved = []
        for at in range(0, 64, width):
            field = lambda x, at=at: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            unit = F.lit(1 << at).cast("bigint")
            moved += [lambda x, f=field, u=unit: F.when(f(x) < width, x + u), lambda x, f=field, u=unit: F.when(f(x) > 0, x - u)]
        if i:
            cells = F.array_distinct(F.flatten(F.transform(cells, lambda x: F.array_compact(F.array(x, *[m(x) for m in moved])))))  # noqa: B023
        else:
            cells = F.array_compact(F.array(vector, *[m(vector) for m in moved]))
    return cells


def flips(value: Column, radius: int) -> Column:
    """All 64-bit values within so many bits."""
    out = F.array(value)
    for _ in range(radius):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.concat(F.array(x), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))))))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of the distinct values of the column fingerprint, which connect all that are within the distance."""
    outer, inner = (distance + 1) // 2, distance // 2
    vector = popcounts(F.col("fingerprint"), width)
    filed = distinct.select("fingerprint", vector.alias("v")).select("fingerprint", "v", F.explode(nearby(F.col("v"), outer, width)).alias("cell"))
    heavy = stored(filed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell"))
    n = heavy.count()
    known = F.broadcast(heavy) if n <= BROADCAST_CELLS else heavy
    light = filed.join(known, "cell", "left_anti") if n else filed
    a, b = light.alias("a"), light.alias("b")
    c = F.col
    close = F.bit_count(c("a.fingerprint").bitwiseXOR(c("b.fingerprint"))) <= distance
    # equal vectors share all their cells and are paired in their own
    once = (c("a.v") != c("b.v")) | (c("a.cell") == c("a.v"))
    out = a.join(b, (c("a.cell") == c("b.cell")) & (c("a.fingerprint") < c("b.fingerprint")) & once & close)
    out = out.select(c("a.fingerprint").alias("a"), c("b.fingerprint").alias("b")).distinct()
    if n:
        crowd = filed.join(known, "cell", "left_semi").select("fingerprint").distinct()
        out = out.unionByName(crowded_links(stored(crowd), outer, inner))
    return out


def crowded_links(distinct: DataFrame, outer: int, inner: int) -> DataFrame:
    """Stars (a, b) that connect all values whose distance is at most ``outer + inner`` bits, exactly and without pairs."""
    x = F.col("fingerprint")
    around = distinct.select("fingerprint", F.explode(flips(x, outer)).alias("value"))
    near = F.bit_count(x.bitwiseXOR(F.col("value"))) <= inner
    least = around.groupBy("value").agg(F.min(F.when(near, x)).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("value", "least")
    return around.join(least, "value").where(x != F.col("least")).select(F.col("least").alias("a"), x.alias("b")).distinct()


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id linked with it)."""
    signed = stored(fingerprints(documents, doc_id=doc_id, text=text, shingle=shingle, seed=seed))
    has = signed.where("doc_id is not null")
    values = stored(has.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    # rows of one id with different texts belong together
    twice = has.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("hi")).where("a <> hi").select("doc_id", "a")
    joined = has.join(twice, "doc_id").where(F.col("fingerprint") != F.col("a")).select("a", F.col("fingerprint").alias("b"))
    found = stored(components(links(values.select("fingerprint"), distance, width, cell).unionByName(joined)))
    placed = values.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    heads = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(placed.select("fingerprint", "component").join(heads, "component").select("fingerprint", "component_id"))
    out = signed.join(classes, "fingerprint", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents, linked at two or fewer differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
