"""Spelling variants: words grouped with the frequent words that are one edit away.

Words are counted over all documents. A word's neighbourhood is all that one deletion, replacement or insertion makes of it
over the observed alphabet; what of it is in the vocabulary is near, without a check of distances. A neighbourhood has about a
thousand strings, so it isn't shuffled: words are sent to where their neighbours can be, and meet them in a hash table there.
An edit at place p of the longer word, of M letters, leaves the first M // 2 letters or the others as they are, so a word goes
to four groups: by the first and by the second half of itself, and of what an inserted letter makes of it. In a group
neighbourhoods take edits in the free half only, with the letters that the group's vocabulary has at each place; other letters
give no word of it. An edit in a run of equal letters counts at the run's first place, so each result is made once.

Words of more than ``LONG`` letters have neighbourhoods of the square of their length. Theirs are made as 64-bit hashes, each
from the word's prefix sums in one step, and what hits is compared letter by letter.

A word's form is its most frequent neighbour (of equal ones the first in code-point order), if that is ``ratio`` times as frequent; forms are
followed to the root by pointer jumping, which ends as counts grow by the ratio at each step.

Cases: null and empty texts have no words; a null doc_id hashes as an empty one; rows that repeat a doc_id each count; words
shorter than ``min_length`` or rarer than ``min_count`` are no words; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import prepare, quoted

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, MISSPELT = 6, 5, 5, 199
#: Words of more letters have hashed neighbourhoods.
LONG = 256
#: Rows of an Arrow batch of near pairs.
ROWS = 1 << 14

_BASE = 0x9E3779B97F4A7C15


def word_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n). Of a run whose crc32 with its doc_id ``misspelt`` divides, the letter that the crc32 names is left out."""
    runs = documents.select(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(quoted(text)), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(misspelt)) == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = h.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def halves(words: DataFrame) -> DataFrame:
    """(size, side, half, word, n): the groups of each word. size: the letters of the longer word of a pair; side 0: the first half stays."""
    n = F.length("word")
    shape = F.struct
    sizes = F.array(n, n + 1)
    groups = F.flatten(F.transform(sizes, lambda m: F.array(
        shape(m.alias("size"), F.lit(0).alias("side"), F.substr("word", F.lit(1), F.floor(m / 2).cast("int")).alias("half")),
        shape(m.alias("size"), F.lit(1).alias("side"), F.substr("word", n - (m - F.floor(m / 2).cast("int")) + 1).alias("half")),
    )))
    return words.select("word", "n", F.explode(groups).alias("g")).select("g.size", "g.side", "g.half", "word", "n")


def group_pairs(size: int, side: int, full: list[str], short: list[str]) -> Iterator[tuple[str, str]]:
    """(word, near word), both ways, of a group's words of ``size`` letters and of those of one letter less."""
    if len(full) + len(short) < 2 or not full:
        return
    free = range(size // 2, size) if side == 0 else range(size // 2)
    if size > LONG:
        yield from long_pairs(free, full, short)
        return
    whole, less = set(full), set(short)
    letters = {p: {w[p] for w in full} for p in free}
    for w in full:
        before = w[free.start - 1] if free.start else ""
        for p in free:
            x, head, tail = w[p], w[:p], w[p + 1 :]
            if less and x != before and head + tail in less:
                yield w, head + tail
            before = x
            for c in letters[p]:
                if c != x and head + c + tail in whole:
                    yield w, head + c + tail
    for w in short:
        for p in free:
            head, tail = w[:p], w[p:]
            for c in letters[p]:
                if head[-1:] != c and head + c + tail in whole:
                    yield w, head + c + tail


def hashed(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word's code points, the powers of the base and the sums of their products up to each place, modulo 2^64."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(points), _BASE, np.uint64)])
    return points, power, np.r_[np.uint64(0), np.cumsum(points * power[:-1], dtype=np.uint64)]


def long_pairs(free: range, full: list[str], short: list[str]) -> Iterator[tuple[str, str]]:
    """As group_pairs, with neighbourhoods of hashes; a hit is compared letter by letter."""
    sums = {w: int(hashed(w)[2][-1]) for w in [*full, *short]}
    by_sum: dict[tuple[int, int], list[str]] = {}
    for w, s in sums.items():
        by_sum.setdefault((len(w), s), []).append(w)
    known = {n: np.array(sorted(s for m, s in by_sum if m == n), np.uint64) for n in {len(full[0]), len(full[0]) - 1}}
    size = len(full[0])
    letters = [np.unique(np.array([ord(w[p]) for w in full], np.uint64)) for p in free]
    n_letters = np.array([len(x) for x in letters])
    place, letter = np.repeat(np.array(free), n_letters), np.concatenate(letters)
    for w in [*full, *short]:
        points, power, total = hashed(w)
        made = []
        if len(w) == size:
            p = np.array([p for p in free if not p or w[p] != w[p - 1]], np.int64)
            made.append((size - 1, p, total[p] + (total[-1] - total[p + 1]) * np.uint64(pow(_BASE, -1, 1 << 64)), None))
            some = letter != points[place]
            p, c = place[some], letter[some]
            made.append((size, p, total[-1] + (c - points[p]) * power[p], c))
        else:
            some = (place == 0) | (letter != points[place - 1])
            p, c = place[some], letter[some]
            made.append((size, p, total[p] + c * power[p] + (total[-1] - total[p]) * np.uint64(_BASE), c))
        for n, p, value, c in made:
            for i in np.flatnonzero(np.isin(value, known[n])).tolist():
                at = int(p[i])
                if c is None:
                    candidate = w[:at] + w[at + 1 :]
                else:
                    candidate = w[:at] + chr(int(c[i])) + w[at + (n == len(w)) :]
                if candidate in by_sum[n, int(value[i])]:
                    yield w, candidate


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words of (word, n) that differ by one edit, both ways, each once."""
    prepare(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, rows = None, {}, ([], [], [])

        def close() -> None:
            if key is not None:
                full = [w for w in count if len(w) == key[0]]
                for w, x in group_pairs(key[0], key[1], full, [w for w in count if len(w) < key[0]]):
                    for out, v in zip(rows, (w, x, count[x]), strict=True):
                        out.append(v)

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for *group, word, n in zip(*(batch[c].to_pylist() for c in ("size", "side", "half", "word", "n")), strict=True):
                if group != key:
                    close()
                    key, count = group, {}
                    if len(rows[0]) >= ROWS:
                        yield batch_of()
                count[word] = n
        close()
        yield batch_of()

    groups = halves(words)
    keys = ["size", "side", "half"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) without null: forms followed to the last, by pointer jumping."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, misspelt: int = MISSPELT) -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n and root."""
    words = stored(word_counts(documents, doc_id=doc_id, text=text, min_length=min_length, min_count=min_count, misspelt=misspelt))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= F.col("n") * ratio
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    judged = stored(judged)
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """All documents: words of six letters that occur five times, with variants five times as frequent."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
