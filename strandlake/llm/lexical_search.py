"""Ranked lexical search: an inverted index in shards, and document-at-a-time evaluation of a set of queries.

Index: each task turns the rows that it reads into shards of ``SHARD_BYTES`` of text (or one longer row); nothing is shuffled.
A shard has its documents in the order of their ids, its terms, and for each term the postings (a gap of document places
and a term frequency each) as numbers of seven bits a byte. The index is a table; the statistics over all shards are sums.

Search: a shard's lists of the terms that are asked for are decoded and turned into scores once, for all queries. For each
query a heap holds the next document of each list; the least document leaves with all its lists, is scored, and goes to the query's
bounded heap of results, keyed by score, then doc_id. Lists whose greatest scores together stay below the worst result
that is kept can't bring a new document by themselves: they are left out of the merge and asked for single documents only,
from the strongest on, until the document can't reach that result either. This is exact: what could tie is still scored. The
heaps go from shard to shard of a task; a last window merges the tasks' results.

Scores: terms are runs of ASCII letters, digits and non-ASCII characters in lower case. N counts documents with a term, L all
terms, n a document's, df the documents with a term, tf its occurrences in one; w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 100 -
b + (b n N) div L with b = 75, and a document's score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included.

Cases: null and empty texts have no terms and are never returned; documents that score 0 aren't either; rows that repeat a
doc_id are documents of their own; a null doc_id comes after all ids of equal score; equal rows of queries count once and
several texts of one query id are one query; a null query id is not asked; very long texts are shards of their own; no rows
give no rows; other columns are not read. Queries are taken in blocks of ``BLOCK_BYTES`` of text, so what is broadcast is bounded.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import stored, written
from strandlake.llm._text import ALNUM_LOWER, Words, chunks, prepare, quoted

TOP, B = 10, 75
SHARD_BYTES = 8 << 20
#: Text of queries whose terms are sent to the executors at once.
BLOCK_BYTES = 4 << 20
#: Stands for a null doc_id: above all others.
NO_ID = 1 << 63

#: n_null: how many documents at a shard's end have a null doc_id.
INDEX = "n_docs bigint, n_terms bigint, n_null bigint, doc_ids binary, lengths binary, terms binary, df binary, sizes binary, postings binary"


# Numbers of seven bits a byte --------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the numbers (not negative), low bits first, the last of each below 128; and the bytes that each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        size += values >= np.uint64(1 << k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin, some, k = end - size, np.arange(len(values)), 0
    while len(some):
        low = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        more = size[some] > k + 1
        out[begin[some] + k] = low.astype(np.uint8) | (more.astype(np.uint8) << 7)
        some, k = some[more], k + 1
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of such bytes."""
    end = np.flatnonzero(data < 128)
    begin = np.r_[0, end[:-1] + 1] if len(end) else end
    place = np.arange(len(data)) - np.repeat(begin, end - begin + 1)
    parts = (data & 127).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(parts, begin) if len(begin) else np.zeros(0, np.uint64)


# Index -------------------------------------------------------------------------------------------------------------------------


def term_array(words: Words) -> pa.Array:
    """The words of a chunk as strings."""
    offsets = np.r_[0, np.cumsum(words.end - words.start)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(words.data[words.data != 0]))


class Shard:
    """Documents that become one row of the index."""

    def __init__(self) -> None:
        self.bytes, self.n = 0, 0
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        words = Words(texts, ALNUM_LOWER)
        coded = term_array(words).dictionary_encode()
        n = max(len(coded.dictionary), 1)
        pair, tf = np.unique(words.row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.parts.append((coded.dictionary, pair // n + self.n, pair % n, tf))
        self.ids.append(ids)
        self.lengths.append(words.count)
        self.n += len(ids)
        self.bytes += len(words.raw)

    def row(self) -> dict:
        ids, lengths = pa.chunked_array(self.ids, pa.int64()), np.concatenate(self.lengths)
        null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, null))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        coded = pa.chunked_array([p[0] for p in self.parts], pa.large_string()).combine_chunks().dictionary_encode()
        code, at = coded.indices.to_numpy(zero_copy_only=False), np.cumsum([0] + [len(p[0]) for p in self.parts])
        term = np.concatenate([code[a + p[2]] for a, p in zip(at[:-1], self.parts, strict=True)])
        doc, tf = rank[np.concatenate([p[1] for p in self.parts])], np.concatenate([p[3] for p in self.parts])
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        gap = np.diff(doc, prepend=0)
        df = np.bincount(term, minlength=len(coded.dictionary))
        first = np.cumsum(df) - df
        gap[first[df > 0]] = doc[first[df > 0]]
        data, size = pack(np.column_stack([gap, tf]).ravel())
        sizes = np.add.reduceat(size, 2 * first) if len(first) else np.zeros(0, np.int64)
        terms = "\0".join(coded.dictionary.to_pylist()).encode()
        return {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "n_null": int(null.sum()), "doc_ids": ids[order].astype("<i8").tobytes(), "lengths": pack(lengths[order])[0].tobytes(), "terms": terms, "df": pack(df)[0].tobytes(), "sizes": pack(sizes)[0].tobytes(), "postings": data.tobytes()}


def index(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, a row a shard: counts of documents and terms, and the shard's parts as bytes."""
    prepare(documents.sparkSession)
    types = [pa.int64()] * 3 + [pa.binary()] * 6
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        batch_of = lambda row: pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(names, types, strict=True)], names=names)
        for batch in batches:
            for part in chunks(batch, "text"):
                shard.add(part["doc_id"], part["text"])
                if shard.bytes >= shard_bytes:
                    yield batch_of(shard.row())
                    shard = Shard()
            batch = part = None
            pa.default_memory_pool().release_unused()
        if shard.n:
            yield batch_of(shard.row())

    return documents.select(F.col(quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(run, INDEX)


# Search ------------------------------------------------------------------------------------------------------------------------


def places(asked: pa.Array, terms: bytes) -> np.ndarray:
    """The place of each asked term among a shard's, or -1."""
    data = np.frombuffer(terms + b"\0", np.uint8)
    ends = np.flatnonzero(data == 0)
    if not len(terms):
        return np.full(len(asked), -1)
    begins = np.r_[0, ends[:-1] + 1]
    held = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.r_[0, np.cumsum(ends - begins)].astype(np.int64)), pa.py_buffer(data[data != 0]))
    return pc.fill_null(pc.index_in(asked, value_set=held), -1).to_numpy(zero_copy_only=False)


def document_frequencies(shards: DataFrame, asked: list[str]) -> np.ndarray:
    """In how many documents of all shards each asked term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(held.value, pa.large_string()), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for terms, df in zip(batch["terms"].to_pylist(), batch["df"].to_pylist(), strict=True):
                at = places(wanted, terms)
                total[at >= 0] += unpack(np.frombuffer(df, np.uint8)).astype(np.int64)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    held = shards.sparkSession.sparkContext.broadcast(asked)
    rows = shards.select("terms", "df").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(asked), np.int64)
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def best(query: list[tuple[int, int]], lists: dict[int, tuple[list[int], list[int], int, dict[int, int]]], ids: list[int], found: list[tuple[int, int]], top: int) -> None:
    """The query's documents of a shard, into the heap ``found`` of (score, -id), which keeps the best.

    query: (term, repeats). lists: documents (places in ids, ascending), scores, the greatest score, and scores by document.
    """
    own = sorted((lists[t][2] * q, t, q) for t, q in query if t in lists)
    bound = [0]
    for most, _, _ in own:
        bound.append(bound[-1] + most)
    floor_ = found[0][0] if len(found) == top else 1
    if bound[-1] < floor_:
        return
    side = 0  # the lists before it are out of the merge
    while bound[side + 1] < floor_:
        side += 1
    docs, scores, times = [lists[t][0] for _, t, _ in own], [lists[t][1] for _, t, _ in own], [q for _, _, q in own]
    heap = [(docs[k][0], k, 0) for k in range(side, len(own))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            _, k, i = heap[0]
            score += scores[k][i] * times[k]
            i += 1
            if k >= side and i < len(docs[k]):
                heapq.heapreplace(heap, (docs[k][i], k, i))
            else:
                heapq.heappop(heap)
        j = side
        while j and score + bound[j] >= floor_:
            j -= 1
            score += lists[own[j][1]][3].get(doc, 0) * times[j]
        if j or score < floor_:
            continue
        entry = (score, -ids[doc])
        if len(found) < top:
            heapq.heappush(found, entry)
        elif entry > found[0]:
            heapq.heapreplace(found, entry)
        if len(found) == top and found[0][0] > floor_:
            floor_ = found[0][0]
            if bound[-1] < floor_:
                return
            was = side
            while bound[side + 1] < floor_:
                side += 1
            if side > was:  # lists that left the merge are asked by document from now on
                heap = [x for x in heap if x[1] >= side]
                heapq.heapify(heap)


def search_block(shards: DataFrame, queries: list[tuple[int, Counter]], n: int, total: int, top: int, b: int) -> DataFrame:
    """(query, doc_id, score) of the best documents of each task for each query (its number in the list), stored."""
    asked = sorted({t for _, c in queries for t in c})
    df = document_frequencies(shards, asked)
    weights = [weight(n, int(x)) for x in df]
    number = {t: i for i, t in enumerate(asked)}
    held = shards.sparkSession.sparkContext.broadcast((asked, weights, [[(number[t], q) for t, q in c.items()] for _, c in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, wanted = held.value
        array = pa.array(terms, pa.large_string())
        found: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for batch in batches:
            for r in range(batch.num_rows):
                part = {c: batch[c][r].as_buffer() for c in ("doc_ids", "lengths", "df", "sizes", "postings")}
                at = places(array, batch["terms"][r].as_py())
                some = [t for t in np.flatnonzero(at >= 0).tolist() if weights[t] > 0]
                ids = np.frombuffer(part["doc_ids"], "<i8").tolist()
                null = batch["n_null"][r].as_py()
                ids[len(ids) - null :] = [NO_ID] * null
                read = lambda c: unpack(np.frombuffer(part[c], np.uint8)).astype(np.int64)  # noqa: B023, E731
                m = np.array([100 - b + b * x * n // total for x in read("lengths").tolist()], np.int64)
                df, ends = read("df"), np.cumsum(read("sizes"))
                data, lists = np.frombuffer(part["postings"], np.uint8), {}
                for t in some:
                    i = int(at[t])
                    pairs = unpack(data[(ends[i - 1] if i else 0) : ends[i]]).astype(np.int64)
                    docs, tf = np.cumsum(pairs[::2]), pairs[1::2]
                    scores = (weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))).tolist()
                    docs = docs.tolist()
                    lists[t] = (docs, scores, max(scores), dict(zip(docs, scores, strict=True)))
                for query, heap in zip(wanted, found, strict=True):
                    best([x for x in query if x[0] in lists], lists, ids, heap, top)
        rows = [(q, None if -d == NO_ID else -d, s) for q, heap in enumerate(found) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    out = stored(shards.select("n_null", "doc_ids", "lengths", "terms", "df", "sizes", "postings").mapInArrow(run, "query int, doc_id bigint, score bigint"))
    held.unpersist()
    return out


def query_blocks(queries: DataFrame, query_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, Counter]]]:
    """Queries with their counted terms, in blocks of so many bytes of text (or one longer query), read one after the other."""
    rows = queries.select(F.col(quoted(query_id)).alias("id"), F.col(quoted(text)).alias("text")).where("id is not null").distinct().orderBy("id", "text")
    block: list[tuple[int, Counter]] = []
    size = 0
    for row in rows.toLocalIterator():
        terms = Counter(term_array(Words(pa.array([row["text"]], pa.large_string()), ALNUM_LOWER)).to_pylist())
        if block and block[-1][0] == row["id"]:
            block[-1][1].update(terms)
        else:
            if size >= block_bytes:
                yield block
                block, size = [], 0
            block.append((row["id"], terms))
        size += len(row["text"] or "")
    if block:
        yield block


def search(shards: DataFrame, queries: DataFrame, *, query_id: str = "item_id", text: str = "text", top: int = TOP, b: int = B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query id, rank, doc_id, score) over a written index: the ``top`` documents of each query, equal scores by doc_id."""
    spark = shards.sparkSession
    kind = queries.select(F.col(quoted(query_id)).alias("id")).schema["id"].dataType.simpleString()
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], f"id {kind}, doc_id bigint, score bigint")
    if n:
        for block in query_blocks(queries, query_id, text, block_bytes):
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"query int, id {kind}")
            out = out.unionByName(search_block(shards, block, n, total, top, b).join(F.broadcast(names), "query").select("id", "doc_id", "score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("id").alias(query_id), "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    shards = written(index(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return search(shards, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
