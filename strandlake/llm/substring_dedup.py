"""Removal of repeated passages with a compressed FM-index per shard.

A window is ``window`` neighbouring words. Windows are dealt to shards by the least hash of the k-grams in them, so equal
windows meet in one shard whatever documents they stand in; neighbouring windows with one such hash travel together as a
segment of text. Each task sends a segment that it meets again only once, with its earliest place, and the later places
as places to remove, dealt by document; so the copies of a passage never come to one task one by one. Segments travel as
compressed blocks.

A k-gram that stands in very many different surroundings would bring all of them to one shard. So k-grams are counted first,
in ``BUCKETS_A_SHARD`` times as many buckets as there are shards, over all documents; those of buckets with more than
``frequent`` of them, and more than ``TIMES_MEAN`` times the mean, deal no window. A window goes by the least hash of its
other k-grams, and by its own hash where it has none, so no shard grows with the occurrences of one k-gram.

In a shard, segments without any 12-gram that occurs twice are left out; over the others stands an FM-index whose backward
search, by wavelet-matrix ranks, streams every segment through the index and keeps the matching statistics at the window's
length. A window is repeated where its interval holds an earlier place. Hashes only choose what is compared: segments count as equal
by their bytes, and the index's symbols are the words themselves. A shard holds about ``shard_bytes`` of the corpus,
so the number of shards follows the input, and each document is streamed only through the shards of its own windows.

Cases: null or empty texts have no words; a null doc_id comes after all others, the greatest one too; rows that repeat a doc_id with the same
text stand at the same places and none is earlier than the other; with different texts each is judged by its own windows; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import written
from strandlake.llm._text import SPACED, Words, chunks, over_texts, prepare, quoted, ragged, rolled, same_row, spans_hash
from strandlake.llm.fm_index import FMIndex

WINDOW, GRAM, FILTER_GRAM = 20, 4, 12
SHARD_BYTES, BLOCK_BYTES, SEGMENT_WINDOWS = 4 << 20, 6 << 20, 62
#: Shards that one task takes on, one after another.
SHARDS_A_TASK = 16
#: Buckets in which k-grams are counted, and the counts from which on a bucket's k-grams deal no window. An occurrence
#: brings up to 36 words to its shard, so at seven bytes a word the first of the counts is about ``SHARD_BYTES`` of text.
BUCKETS_A_SHARD, FREQUENT, TIMES_MEAN = 8, 1 << 14, 4
#: k-grams that a task counts at a time.
COUNTED = 1 << 21
#: What a null doc_id is sent as, with this bit in the row's tag: it comes after a document that has this id.
LAST, NULL = (1 << 63) - 1, 1 << 30
#: The columns of a block and of its list of places to remove, as they stand there one after another.
SENT = (("ids", "<i8"), ("tags", "<i4"), ("start", "<i4"), ("windows", "u1"), ("size", "<i4"))


def packed(sent: list[np.ndarray], lost: list[np.ndarray], text: np.ndarray) -> bytes:
    """A block: how many segments and places to remove, their columns, and the segments' text."""
    columns = [x.astype(t).tobytes() for x, (_, t) in zip([*sent, *lost], (*SENT, *SENT[:4]), strict=True)]
    return b"".join((np.array([len(sent[0]), len(lost[0])], "<i4").tobytes(), *columns, text.tobytes()))


def unpacked(block: bytes) -> list[np.ndarray]:
    """The segments' columns, the removed places' columns and the text."""
    n, at, out = np.frombuffer(block, "<i4", 2).tolist(), 8, []
    for part, columns in zip(n, (SENT, SENT[:4]), strict=True):
        for _, t in columns:
            out.append(np.frombuffer(block, t, part, at))
            at += out[-1].nbytes
    return [*out, np.frombuffer(block, np.uint8, offset=at)]


def owners(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The documents' places in the order of ids, null ones last."""
    late = tags >> 30
    order = np.lexsort((late, ids))
    i, l = ids[order], late[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.r_[False, (i[1:] != i[:-1]) | (l[1:] != l[:-1])])[: len(ids)]
    return out


class Frequent:
    """The buckets whose k-grams deal no window, a bit each: an eighth of a byte for every half megabyte of the corpus."""

    def __init__(self, buckets: int, chosen: np.ndarray) -> None:
        self.buckets, self.bits = np.uint64(buckets), np.zeros(buckets // 8 + 1, np.uint8)
        np.bitwise_or.at(self.bits, chosen >> 3, (1 << (chosen & 7)).astype(np.uint8))

    def holds(self, h: np.ndarray) -> np.ndarray:
        bucket = (h % self.buckets).astype(np.int64)
        return (self.bits[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def bucket_counts(texts: DataFrame, buckets: int, gram: int) -> DataFrame:
    """bucket and n: how many k-grams of the texts have a hash in the bucket."""

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part["text"], SPACED)
                held.append((rolled(words.hash, gram)[same_row(words.row, gram)] % np.uint64(buckets)).astype(np.int64))
                size += len(held[-1])
                if size >= COUNTED:
                    yield tally(held)
                    held, size = [], 0
        if held:
            yield tally(held)

    return texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def frequent_grams(texts: DataFrame, shards: int, gram: int, frequent: int) -> Frequent | None:
    """The buckets of k-grams too frequent to deal windows; at most a ``TIMES_MEAN``-th of all. One shard needs none."""
    if shards < 2:
        return None
    buckets = shards * BUCKETS_A_SHARD
    counts = written(bucket_counts(texts, buckets, gram))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chosen = counts.where(F.col("n") > max(frequent, TIMES_MEAN * total // buckets)).select("bucket").toArrow()["bucket"].to_numpy()
    return Frequent(buckets, chosen) if len(chosen) else None


def segments(words: Words, window: int, gram: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, hash) of the runs of windows in one row that are dealt by the same hash."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    least, have, none = rolled(words.hash, gram), 1, np.uint64((1 << 64) - 1)
    if frequent is not None:
        least = np.where(frequent.holds(least), none, least)
    span = window - gram + 1
    while have < span:
        more = min(have, span - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    if frequent is not None and (bare := np.flatnonzero(least == none)).size:
        least[bare] = rolled(words.hash, window)[bare]
    inside = words.row[:n] == words.row[window - 1 :]
    new = np.r_[True, (least[1:] != least[:-1]) | (words.row[1:n] != words.row[: n - 1])]
    at = np.flatnonzero(new | np.r_[False, inside[1:] != inside[:-1]])
    size = np.diff(np.r_[at, n])
    keep = inside[at]
    at, size = at[keep], size[keep]
    parts = -(-size // SEGMENT_WINDOWS)
    within = ragged(np.zeros(len(at), np.int64), parts)
    row = np.repeat(np.arange(len(at)), parts)
    start = at[row] + within * SEGMENT_WINDOWS
    return start, np.minimum(size[row] - within * SEGMENT_WINDOWS, SEGMENT_WINDOWS), least[at[row]]


def grouped(order: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments in an order that has equal keys together: whether each is the first of its text, and that first one.

    A segment with the key of the one before it and other bytes is a first one by itself.
    """
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else order
    again = np.flatnonzero(~new)
    i, h = order[again], first[again]
    differs = size[i] != size[h]
    some = np.flatnonzero(~differs)
    n = size[i[some]].astype(np.int64)
    if n.sum():
        unlike = text[ragged(begin[i[some]], n)] != text[ragged(begin[h[some]], n)]
        differs[np.repeat(some, n)[unlike]] = True
    alone = again[differs]
    new[alone] = True
    first[alone] = order[alone]
    return new, first


def symbols(texts: pa.Array) -> np.ndarray:
    """A number from 1 on for each word of the texts, the same for equal words only."""
    parts = []
    for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        words = Words(part["text"], SPACED)
        offsets = np.r_[0, np.cumsum(words.end - words.start)].astype(np.int64)
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(words.raw[words.data != 0])]))
    return pa.chunked_array(parts, pa.large_binary()).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1


class Sender:
    """Gathers a task's segments and turns them into blocks for the shards."""

    def __init__(self, shards: int, window: int, gram: int, frequent: Frequent | None = None) -> None:
        import zstandard

        self.shards, self.window, self.gram, self.frequent, self.pack = shards, window, gram, frequent, zstandard.ZstdCompressor(level=3).compress
        self.held: list[tuple] = []
        self.bytes = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, texts: pa.Array) -> list[tuple[int, bytes]]:
        words = Words(texts, SPACED)
        start, windows, least = segments(words, self.window, self.gram, self.frequent)
        end = start + windows + self.window - 1
        row = words.row[start] if len(start) else start
        a, b = words.start[start], words.end[end - 1] if len(start) else start
        text = words.raw[ragged(a, b - a)]
        self.held.append((ids[row], tags[row], (start - words.first[row]).astype(np.int32), windows.astype(np.uint8), least, spans_hash(words.hash, start, end), (b - a).astype(np.int32), text))
        self.bytes += len(words.raw)
        return self.flush() if self.bytes >= BLOCK_BYTES else []

    def flush(self) -> list[tuple[int, bytes]]:
        if not self.held:
            return []
        ids, tags, start, windows, least, key, size, text = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.bytes = [], 0
        owner = owners(ids, tags)
        order = np.lexsort((start, owner, key))
        begin = np.cumsum(size.astype(np.int64)) - size
        earliest, first = grouped(order, key, begin, size, text)
        same = (owner[order] == owner[first]) & (start[order] == start[first])
        send, drop = order[earliest | same & (tags[order] != tags[first])], order[~same]
        shard, lost = (least[send] % np.uint64(self.shards)).astype(np.int64), (ids[drop] % self.shards).astype(np.int64)
        send, shard = (x[np.argsort(shard, kind="stable")] for x in (send, shard))
        drop, lost = (x[np.argsort(lost, kind="stable")] for x in (drop, lost))
        out = []
        for s in np.union1d(shard, lost).tolist():
            i = np.sort(send[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")])
            d = drop[np.searchsorted(lost, s) : np.searchsorted(lost, s, "right")]
            block = packed([x[i] for x in (ids, tags, start, windows, size)], [x[d] for x in (ids, tags, start, windows)], text[ragged(begin[i], size[i])])
            out.append((s, self.pack(block)))
        return out


def ones(n: np.ndarray) -> np.ndarray:
    return (np.int64(1) << n.astype(np.int64)) - np.int64(1)


def shard_repeats(blocks: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc_id, tag, start, mask of repeated windows) of the segments of one shard that have any."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    ids, tags, start, windows, size, *lost, text = (np.concatenate(x) for x in zip(*(unpacked(unpack(b)) for b in blocks), strict=True))
    out = [(lost[0], lost[1], lost[2], ones(lost[3]))]
    offsets = np.r_[0, np.cumsum(size.astype(np.int64))]
    rows = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text))
    batch = pa.RecordBatch.from_arrays([rows], names=["text"])
    hashes = np.concatenate([Words(part["text"], SPACED).hash for part in chunks(batch, "text")]) if len(size) else np.zeros(0, np.uint64)
    length = windows.astype(np.int64) + window - 1
    first = np.cumsum(length) - length
    if len(size):
        # equal segments: the earliest stands for all
        key = spans_hash(hashes, first, first + length)
        owner = owners(ids, tags)
        order = np.lexsort((start, owner, key))
        new, head = grouped(order, key, offsets[:-1], size, text)
        later = (owner[order] != owner[head]) | (start[order] != start[head])
        d = order[later]
        out.append((ids[d], tags[d], start[d], ones(windows[d])))
        twins, of_twins = order[~new & ~later], head[~new & ~later]  # one place, told apart by the text as a whole
        kept = np.sort(order[new])
        # only segments with a gram that stands twice can hold a repeated window
        places = ragged(first[kept], windows[kept].astype(np.int64))
        of = np.repeat(np.arange(len(kept)), windows[kept])
        grams = rolled(hashes, min(FILTER_GRAM, window))[places]
        ordered = np.sort(grams)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        found = np.searchsorted(twice, grams)
        hit = (found < len(twice)) & (twice[np.minimum(found, len(twice) - 1)] == grams) if len(twice) else np.zeros(len(grams), bool)
        live = kept[np.unique(of[hit])]
        if len(live):
            flat = symbols(rows.take(pa.array(live)))
            mask = repeated_windows(flat, length[live], owner[live], start[live], windows[live], window)
            some = mask != 0
            out.append((ids[live][some], tags[live][some], start[live][some], mask[some]))
            if len(twins):
                found = np.zeros(len(size), np.int64)
                found[live] = mask
                out.append((ids[twins], tags[twins], start[twins], found[of_twins]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(flat: np.ndarray, length: np.ndarray, owner: np.ndarray, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """For each segment the mask of its windows that start earlier too, by the index's intervals. flat: the segments' symbols."""
    at = np.cumsum(length + 1) - (length + 1)
    symbols = np.zeros(int((length + 1).sum()), np.int64)
    symbols[ragged(at, length)] = flat
    index = FMIndex(symbols, window)
    # places in order of (document, start)
    n = windows.astype(np.int64)
    places, segment = ragged(at, n), np.repeat(np.arange(len(n)), n)
    doc, word = owner[segment], start[segment].astype(np.int64) + places - at[segment]
    order = np.lexsort((word, doc))
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[False, (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])])
    place = np.full(len(symbols), LAST)
    place[places] = rank
    earliest = np.minimum.reduceat(place[index.suffixes], index.low)
    mask = np.zeros(len(n), np.int64)
    for text, position, group in index.intervals(symbols, at, length):
        again = earliest[group] < place[position]
        np.bitwise_or.at(mask, text[again], np.int64(1) << (position - at[text])[again])
    return mask


REPEATS = "doc_id bigint, tag int, start int, mask bigint"


def substring_dedup(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the words left, joined by a blank) and kept_sha256."""
    prepare(documents.sparkSession)
    text_ = F.col(quoted(text))
    docs = documents.select(F.coalesce(F.col(quoted(doc_id)), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(text_, F.lit(""))).bitwiseAND(NULL - 1).bitwiseOR(F.when(F.col(quoted(doc_id)).isNull(), NULL).otherwise(0)).cast("int").alias("tag"), text_.alias("text"))
    total = documents.agg(F.coalesce(F.sum(F.octet_length(text_)), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    held = documents.sparkSession.sparkContext.broadcast(frequent_grams(docs.select("text"), shards, gram, frequent))  # a bit a bucket

    def send(batches):
        sender = Sender(shards, window, gram, held.value)
        block = lambda x: pa.RecordBatch.from_arrays([pa.array([s for s, _ in x], pa.int64()), pa.array([b for _, b in x], pa.binary())], names=["shard", "block"])
        for batch in batches:
            for part in chunks(batch, "text"):
                if out := sender.add(part["doc_id"].to_numpy(), part["tag"].to_numpy(), part["text"]):
                    yield block(out)
        if out := sender.flush():
            yield block(out)

    def receive(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("doc_id", "tag", "start", "mask"), shard_repeats(rows["block"].tolist(), window), strict=True)))

    sent = docs.mapInArrow(send, "shard bigint, block binary")
    # tasks follow the shards, and so the input, whatever the session's number of partitions
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_TASK))
    repeats = sent.repartition(tasks, "shard").groupBy("shard").applyInPandas(receive, REPEATS)
    repeats = repeats.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    joined = docs.join(repeats, ["doc_id", "tag"], "left")

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            words = Words(batch["text"], SPACED)
            removed = marked(words, batch["starts"], batch["masks"], window)
            kept = np.flatnonzero(~removed)
            n = words.end[kept] - words.start[kept] + 1
            data = words.raw[np.minimum(ragged(words.start[kept], n), max(len(words.raw) - 1, 0))].copy()
            ends = np.cumsum(n)
            data[ends - 1] = 0x20
            total = np.r_[0, ends][np.searchsorted(kept, words.first)]
            rows = [data[a : max(a, b - 1)].tobytes() for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
            gone = np.r_[0, np.cumsum(removed)][words.first]
            ids = zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), strict=True)
            return {"doc_id": [None if tag & NULL else i for i, tag in ids], "n_words": words.count, "n_removed": np.diff(gone), "kept_sha256": [hashlib.sha256(r).hexdigest() for r in rows], "kept": [r.decode() for r in rows]}

        return f

    return over_texts(joined, {k: k for k in ("doc_id", "tag", "text", "starts", "masks")}, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string", work)


def marked(words: Words, starts: pa.Array, masks: pa.Array, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    cover = np.zeros(len(words.hash) + 1, np.int64)
    n = np.array([0 if x is None else x for x in (starts.value_lengths().to_pylist())], np.int64)
    if n.sum():
        at = starts.flatten().to_numpy().astype(np.int64) + np.repeat(words.first[:-1], n)
        mask = masks.flatten().to_numpy()
        for j in range(SEGMENT_WINDOWS + 1):
            here = at[mask >> j & 1 == 1] + j
            np.add.at(cover, here, 1)
            np.add.at(cover, here + window, -1)
    return np.cumsum(cover)[:-1] > 0


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words that stand earlier too."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
