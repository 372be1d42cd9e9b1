"""Benchmark decontamination by winnowing.

Fingerprints of a text are the least hashes of its k-grams in each run of ``w`` neighbouring k-grams. With
``k + w - 1 = window`` two texts that share ``window`` words also share a fingerprint within them, so equal fingerprints
find every such span; a hit is then extended word by word, and counts where it covers a whole window.

Items of fewer words than the window are one window each, with fingerprints of their own length.

Test items are indexed once. Up to ``index_limit`` bytes of them are broadcast and documents are matched as they are
scanned, without a shuffle. Beyond it documents' fingerprints that items have too are extended to the windows around them and
joined with the items' windows (``_joined``). Both ways compare the words themselves, not only their hashes.

Cases: a null or empty text has no words; items with a null id or no words never match; rows that repeat a doc_id are
judged each by itself; items that repeat an item_id count once; without items nothing is hit, and no documents give no rows;
other columns are not read, and stay where documents are filtered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._text import ALNUM_LOWER, Words, filter_texts, free, over_texts, quoted, ragged, rolled, same_row

WINDOW, GRAM = 10, 5
INDEX_LIMIT = 8 << 20


def winnow(h: np.ndarray, row: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all rows: the least k-gram (the rightmost of equals) in each ``span`` words."""
    grams, w = rolled(h, k), span - k + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, w):
        new = grams[i : i + n]
        less = new <= least
        least[less] = new[less]
        at[less] = i
    found = np.unique((at + np.arange(n))[same_row(row, span)])
    return found, grams[found]


class Index:
    """Items' words, and for each window length the sorted fingerprints with the places where they stand."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> None:
        kept = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None and t]
        words = Words(pa.array([t for _, t in kept], pa.large_string()), ALNUM_LOWER)
        self.ids, self.hash, self.row, self.first = [i for i, _ in kept], words.hash, words.row, words.first
        self.words = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
        self.families = []
        for span in sorted(set(np.minimum(words.count[words.count > 0], window).tolist())):
            mine = words.count >= window if span == window else words.count == span
            k = min(gram, span)
            at, h = winnow(words.hash, words.row, k, span)
            keep = mine[words.row[at]]
            at, h = at[keep], h[keep]
            order = np.argsort(h, kind="stable")
            self.families.append((span, k, h[order], at[order]))


def matches(index: Index, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item) of the spans of words that hits extend to, within a window's reach."""
    found = []
    for span, k, keys, places in index.families:
        at, mine = winnow(h, row, k, span)
        lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        n = hi - lo
        if not n.any():
            continue
        d = np.repeat(at, n)
        g = places[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        found.append(extend(index, h, row, first, d, g, span, k))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def extend(index: Index, h: np.ndarray, row: np.ndarray, first: np.ndarray, d: np.ndarray, g: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word d of the chunk and word g of the items begin equal k-grams: how far both ways, up to span - k words, they agree."""
    lo_d, hi_d = first[row[d]], first[row[d] + 1]
    lo_g, hi_g = index.first[index.row[g]], index.first[index.row[g] + 1]
    left, right = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    same = np.ones(len(d), bool)
    for i in range(k):  # the grams' own words
        same &= (d + i < hi_d) & (g + i < hi_g)
        same &= h[np.minimum(d + i, len(h) - 1)] == index.hash[np.minimum(g + i, len(index.hash) - 1)]
    for sign, out in ((-1, left), (1, right)):
        on = same.copy()
        for i in range(1, span - k + 1):
            x, y = (d - i, g - i) if sign < 0 else (d + k - 1 + i, g + k - 1 + i)
            on &= (x >= lo_d) & (x < hi_d) & (y >= lo_g) & (y < hi_g)
            on[on] = h[x[on]] == index.hash[y[on]]
            if not on.any():
                break
            out += on
    whole = same & (left + right + k >= span)
    return (d - left)[whole], (d + k + right)[whole], index.row[g][whole]


def _verdicts(index: Index, words: Words) -> dict:
    start, end, item = matches(index, words.hash, words.row, words.first)
    total = len(words.hash)
    if len(start):  # equal hashes are taken for equal words only where the words are equal
        shift = index_shift(index, words, start, end, item)
        start, end, item = start[shift], end[shift], item[shift]
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    hit = np.cumsum(marks)[:-1] > 0
    covered = np.r_[0, np.cumsum(hit)]
    n_hit = covered[words.first[1:]] - covered[words.first[:-1]]
    items: dict[int, set] = {}
    for r, i in set(zip(words.row[start].tolist(), item.tolist(), strict=True)):
        items.setdefault(r, set()).add(str(index.ids[i]))
    listed = [sorted(items.get(r, ())) for r in range(len(words.count))]
    return {"n_words": words.count, "n_hit": n_hit, "items": listed, "hit": hit}


def index_shift(index: Index, words: Words, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which spans' bytes do stand in their item."""
    out = np.zeros(len(start), bool)
    seen: dict[tuple, bool] = {}
    for n, (a, b, i) in enumerate(zip(start.tolist(), end.tolist(), item.tolist(), strict=True)):
        if (ok := seen.get((a, b, i))) is None:
            mine = b" ".join(words.data[x:y].tobytes() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True))
            ok = seen[a, b, i] = b" " + mine + b" " in b" " + b" ".join(index.words[index.first[i] : index.first[i + 1]]) + b" "
        out[n] = ok
    return out


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def _output(ids: pa.Array, found: dict) -> dict:
    listed = found["items"]
    return {"doc_id": ids, "n_words": found["n_words"], "n_hit": found["n_hit"], "n_items": [len(x) for x in listed], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], "contaminated": found["n_hit"] > 0, "items": listed}


def usable(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).alias("text")).where("item_id is not null and text is not null")


def broadcast_index(items: DataFrame, window: int, gram: int, index_limit: int):
    """The items' index for every executor, or None if they hold more than ``index_limit`` bytes."""
    if items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] > index_limit:
        return None
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], window, gram))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """The documents that hold no window of an item, with all columns."""
    items = usable(benchmark, item_id, item_text)
    index = broadcast_index(items, window, gram, index_limit)
    if index is not None:

        def clean(texts: pa.Array) -> np.ndarray:
            return _verdicts(index.value, Words(texts, ALNUM_LOWER))["n_hit"] == 0

        return filter_texts(documents, text, lambda: clean)
    id_, key = free(documents.columns, "id_", "key_")
    bad = _joined(documents, items, doc_id, text, window, gram).where("contaminated").select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    return documents.join(bad, F.col(quoted(doc_id)).eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit(""))) == F.col(key)), "left_anti")


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """A row for each document: its words, those inside windows of items, the items (sorted as strings) and whether any word is hit.

    window: words of a window; gram: words of a hashed k-gram; index_limit: bytes of items up to which they are broadcast.
    """
    items = usable(benchmark, item_id, item_text)
    index = broadcast_index(items, window, gram, index_limit)
    if index is None:
        return _joined(documents, items, doc_id, text, window, gram).drop("key")

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            return _output(batch["doc_id"], _verdicts(index.value, Words(batch["text"], ALNUM_LOWER)))

        return f

    return over_texts(documents, {"doc_id": doc_id, "text": text}, SCHEMA, work)


def _joined(documents: DataFrame, items: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """The way for items of any size: no item is broadcast.

    Fingerprints of documents that no item has are left out by a semi join, which emits no pairs however frequent one is.
    Those left are extended to the windows around them, which meet the items' windows by their words: equal bytes, and a row
    for each window of the items whatever the number of items. Hits are united within each document.
    """
    row = F.struct(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("key"))
    docs = documents.select(row.alias("row"), F.col(quoted(text)).alias("text")).select("row.*", "text")
    spans = sorted({int(r[0]) for r in over_texts(items, {"text": "text"}, "n int", lambda: lambda b: {"n": np.minimum(Words(b["text"], ALNUM_LOWER).count, window)}).where("n > 0").distinct().collect()})

    def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by a blank, and where each begins."""
        n = w.end - w.start + 1
        data = w.data[np.minimum(ragged(w.start, n), max(len(w.data) - 1, 0))].copy()
        at = np.r_[0, np.cumsum(n)]
        data[at[1:] - 1] = 0x20
        return data, at

    def strings(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        n = at[hi] - 1 - at[lo]
        return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(np.r_[0, np.cumsum(n)]), pa.py_buffer(data[ragged(at[lo], n)])).cast(pa.string())

    def marked():
        """Fingerprints of documents with the words around them that windows may hold."""

        def f(b: pa.RecordBatch) -> dict:
            w = Words(b["text"], ALNUM_LOWER)
            data, at = joined(w)
            rows, span_, print_, first, around = [], [], [], [], []
            for span in spans:
                k = min(gram, span)
                place, h = winnow(w.hash, w.row, k, span)
                r = w.row[place]
                lo, hi = np.maximum(w.first[r], place - (span - k)), np.minimum(w.first[r + 1], place + span)
                rows.append(r)
                span_.append(np.full(len(place), span, np.int32))
                print_.append(h.view(np.int64))
                first.append((lo - w.first[r]).astype(np.int32))
                around.append(strings(data, at, lo, hi))
            r = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            whole = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            return {"id": b["doc_id"].take(r), "key": b["key"].take(r), "span": whole(span_, np.int32), "print": whole(print_, np.int64), "first": whole(first, np.int32), "words": pa.chunked_array(around, pa.string()).combine_chunks()}

        return f

    def known():
        """Fingerprints of items, each by the windows' length."""

        def f(b: pa.RecordBatch) -> dict:
            w, span_, print_ = Words(b["text"], ALNUM_LOWER), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for span in spans:
                place, h = winnow(w.hash, w.row, min(gram, span), span)
                n = w.count[w.row[place]]
                h = h[n >= window if span == window else n == span]
                span_.append(np.full(len(h), span, np.int32))
                print_.append(h.view(np.int64))
            return {"span": np.concatenate(span_), "print": np.concatenate(print_)}

        return f

    def item_windows():
        def f(b: pa.RecordBatch) -> dict:
            w = Words(b["text"], ALNUM_LOWER)
            data, at = joined(w)
            span = np.minimum(w.count, window)
            n = np.where(w.count > 0, w.count - span + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            lo = ragged(w.first[:-1], n)
            return {"item": b["id"].take(pa.array(row)), "span": span[row].astype(np.int32), "window": strings(data, at, lo, lo + span[row])}

        return f

    ids = items.select(F.col("item_id").cast("string").alias("id"), "text")
    prints = over_texts(ids, {"text": "text"}, "span int, print bigint", known).distinct()
    left = over_texts(docs, {"doc_id": "doc_id", "key": "key", "text": "text"}, "id bigint, key bigint, span int, print bigint, first int, words string", marked)
    near = left.join(prints, ["span", "print"], "left_semi")
    words = F.split("words", " ")
    at = F.explode(F.sequence(F.lit(0), F.size(words) - F.col("span")))
    near = near.where(F.size(words) >= F.col("span")).select("id", "key", "span", "first", words.alias("words"), at.alias("at"))
    near = near.select(F.col("id").alias("doc_id"), "key", "span", (F.col("first") + F.col("at")).alias("start"), F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ").alias("window")).distinct()
    held = over_texts(ids, {"id": "id", "text": "text"}, "item string, span int, window string", item_windows).groupBy("span", "window").agg(F.collect_set("item").alias("item"))
    spans_df = near.join(held, ["span", "window"]).select("doc_id", "key", "item", "start", (F.col("start") + F.col("span")).alias("end"))
    per_doc = spans_df.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item")))).alias("items"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "items", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("bigint").alias("n_hit"))
    counts = over_texts(docs, {"doc_id": "doc_id", "key": "key", "text": "text"}, "doc_id bigint, key bigint, n_words bigint", lambda: lambda b: {"doc_id": b["doc_id"], "key": b["key"], "n_words": Words(b["text"], ALNUM_LOWER).count})
    out = counts.join(per_doc, counts["doc_id"].eqNullSafe(per_doc["_id"]) & (counts["key"] == per_doc["_key"]), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "key", "n_words", hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), items_.alias("items"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")
