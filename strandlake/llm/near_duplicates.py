"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles (5 lower-case words; a shorter text is one shingle). Under each of 64
permutations both the least and the greatest hash are kept: 128 signature values of 64 hash evaluations a shingle, each of
which agrees for two sets with probability J, their Jaccard similarity. Bands of several values make the candidates; their number
and the sketch distance below follow the similarity from which documents are linked (``banding``, ``farthest``). From 0.85
on there are 25 bands of 5 values, from 0.8 on 32 of 4: two sets at that similarity miss all bands with a probability under
1e-6.

The steps, none of which meets a whole group of copies in one task or emits a group's pairs:
1. equal sets become one representative, the one of least doc_id (an aggregation with map-side combine);
2. in each bucket every member is paired with the bucket's least member only; pairs whose 1-bit sketches (a bit of each
   of the 128 values) are close enough are confirmed on the full sets, and components of the confirmed links are formed;
3. documents of buckets that still hold several components are completed exactly, without meeting all with all. Their
   shingles are ordered from rare to frequent; a pair of the linked similarity shares one of the first shingles of both (of
   the longer set the first ``n - ceil(t n) + 1``, of the shorter ``n - ceil(2 t n / (1 + t)) + 1``), at places that leave
   room for the overlap. So texts that are alike but not linked, such as filled-in forms, do not meet: what they share is
   frequent and comes last. Candidates of different components are confirmed on the full sets. While there are at most
   ``BUCKET_LOAD`` shingles for each of ``LEVEL_BUCKETS`` buckets of hashes, the buckets' counts give the order: shingles that are more
   frequent than a bucket's load still stand out. Beyond, each shingle's exact count is joined to it; both find every pair.
A pair at the linked similarity exceeds the sketch distance with a probability under 1e-7. At similarity 0.85 the distance
is 9.6 of 128 bits on average with a deviation of 3, and pairs up to 28 go on; at 0.8 the average is 12.8 and the bound 33.

Cases: null or empty texts have no shingles and are linked with nothing; rows that repeat a doc_id count as one document
if their texts are equal, else each text has its links and the id joins them; a null doc_id is linked with nothing; no rows
give no rows; of equal ids all rows stay or go together; other columns are not read, and stay where documents are filtered.
"""

from __future__ import annotations

import hashlib
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import SPACED_LOWER, Words, chunks, free, over_texts, prepare, quoted, ragged, rolled
from strandlake.llm.components import components

PERCENT, SHINGLE, PERMUTATIONS, BANDS, ROWS = 85, 5, 64, 25, 5
SKETCH_BITS = 128
#: Shingles are counted in so many buckets, by the first bits of their hashes.
LEVEL_BUCKETS = 1 << 18
LEVEL_SHIFT = 46
#: Beyond so many shingles a bucket, and for shingles that occur so often at least, counts are exact.
BUCKET_LOAD, OFTEN = 64, 16
#: Pairs of one document that meet its set in one task.
PAIRS_A_TASK = 200
#: A pair at the linked similarity shares no band, or is beyond a sketch's distance, with a probability under these.
NO_BAND, BEYOND = 1e-6, 1e-7
#: Candidates' ids are broadcast to the scan of texts up to so many, else joined.
BROADCAST_IDS = 2_000_000


def banding(percent: int, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows with which the bands that fit in the signature miss a pair of this similarity under NO_BAND."""
    values = 2 * permutations
    for rows in range(values, 0, -1):
        if (1 - (percent / 100) ** rows) ** (values // rows) < NO_BAND:
            return values // rows, rows
    raise ValueError(f"{permutations} permutations are too few for a similarity of {percent} percent")


def farthest(percent: int, bits: int) -> int:
    """The least distance of two sketches that a pair of this similarity exceeds with a probability under BEYOND."""
    p = (1 - percent / 100) / 2
    if p <= 0:
        return 0
    tail = 0.0
    for d in range(bits, 0, -1):
        tail += exp(lgamma(bits + 1) - lgamma(d + 1) - lgamma(bits - d + 1) + d * log(p) + (bits - d) * log1p(-p))
        if tail >= BEYOND:
            return d
    return 0


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    grams = rolled(words.hash, k)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(grams[a : a + n - k + 1]))
        else:
            out.append(rolled(words.hash[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Rows of 2 x permutations values: the least and the greatest hash under each. All sets have members."""
    rng = np.random.default_rng(85)
    factors = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(x) for x in sets[:-1]])
    for i in range(permutations):
        h = ((flat * factors[i] + addends[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * i] = np.minimum.reduceat(h, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, at)
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch_a bigint, sketch_b bigint"


def signatures(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: the size and a 128-bit digest of its set, its band keys and its 1-bit sketch."""
    if bands * rows > 2 * permutations:
        raise ValueError("bands * rows is more than the signature's values")

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(Words(batch["text"], SPACED_LOWER), shingle)
            full = [i for i, x in enumerate(sets) if len(x)]
            sign = min_max([sets[i] for i in full], permutations)
            keys = np.zeros((len(full), bands), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    keys[:, b] = mixed(keys[:, b] ^ sign[:, b * rows + r].astype(np.uint64)) + np.uint64(b * rows + r + 1)
            bits = (mixed(sign) >> np.uint64(17)) & np.uint64(1)
            half = [(bits[:, k : k + 64] << np.arange(min(64, bits.shape[1] - k), dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64) for k in (0, 64)]
            digests = [np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]
            place = {r: i for i, r in enumerate(full)}
            listed, signed = keys.view(np.int64), [place.get(i) for i in range(len(sets))]
            return {"doc_id": batch["doc_id"], "n_shingles": [len(x) for x in sets], "set_a": [d[0] for d in digests], "set_b": [d[1] for d in digests], "bands": [[] if i is None else listed[i] for i in signed], "sketch_a": [0 if i is None else half[0][i] for i in signed], "sketch_b": [0 if i is None else half[1][i] for i in signed]}

        return f

    return over_texts(documents, {"doc_id": doc_id, "text": text}, SIGNED, work)


def levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """How frequent the shingles of each bucket of hashes are in (doc_id, text, ...), as twice the logarithm of their count.

    Counts are summed in each task and then over the tasks: LEVEL_BUCKETS rows at most come to the driver.
    """

    def work():
        def f(batches):
            counts = np.zeros(LEVEL_BUCKETS, np.int64)
            for batch in batches:
                for part in chunks(batch, "text"):
                    sets = shingle_sets(Words(part["text"], SPACED_LOWER), shingle)
                    bucket, n = np.unique(np.concatenate(sets) >> np.uint64(LEVEL_SHIFT), return_counts=True)
                    counts[bucket.astype(np.int64)] += n
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

        return f

    prepare(texts.sparkSession)
    rows = texts.select("text").mapInArrow(work(), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEVEL_BUCKETS, np.uint8)
    out[rows["bucket"].to_numpy()] = (2 * np.log2(rows["n"].to_numpy() + 1)).astype(np.uint8)
    return out


def first_shingles(texts: DataFrame, level: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(id, component, n, token, pos, short) of the rarest shingles of (doc_id, text, component): those that a set must share
    with a shorter one, and whether it must also share it with a longer one (``short``)."""
    held = texts.sparkSession.sparkContext.broadcast(level)

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(Words(batch["text"], SPACED_LOWER), shingle)
            size = np.array([len(x) for x in sets], np.int64)
            probe = np.where(size > 0, size + (-size * percent) // 100 + 1, 0)
            index = np.where(size > 0, size + (-2 * size * percent) // (100 + percent) + 1, 0)
            tokens = [x[np.lexsort((x, held.value[(x >> np.uint64(LEVEL_SHIFT)).astype(np.int64)]))[:k]] for x, k in zip(sets, probe.tolist(), strict=True)]
            row, pos = np.repeat(np.arange(len(sets)), probe), ragged(np.zeros(len(sets), np.int64), probe)
            token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            return {"id": batch["doc_id"].take(pa.array(row)), "component": batch["component"].take(pa.array(row)), "n": size[row], "token": token.view(np.int64), "pos": pos, "short": pos < index[row]}

        return f

    return over_texts(texts, {c: c for c in ("doc_id", "text", "component")}, "id bigint, component bigint, n bigint, token bigint, pos bigint, short boolean", work)


def first_shingles_exact(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """As ``first_shingles``, ordered by exact counts: only shingles that occur ``OFTEN`` are joined to all, others count as one kind."""

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            sets = [x.view(np.int64) for x in shingle_sets(Words(batch["text"], SPACED_LOWER), shingle)]
            digests = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
            return {"id": batch["doc_id"], "component": batch["component"], "digest": digests, "n": [len(x) for x in sets], "tokens": sets}

        return f

    sets = over_texts(texts, {c: c for c in ("doc_id", "text", "component")}, "id bigint, component bigint, digest bigint, n bigint, tokens array<bigint>", work)
    rows = sets.select("id", "component", "digest", "n", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= OFTEN)
    ranked = rows.join(often, "token", "left").withColumn("k", F.coalesce("k", F.lit(0).cast("bigint")))
    # rows that repeat an id and text have equal places
    order = Window.partitionBy("id", "component", "digest").orderBy("k", "token")
    n, pos = F.col("n"), F.col("pos")
    placed = ranked.withColumn("pos", F.dense_rank().over(order).cast("bigint") - 1)
    placed = placed.where(pos <= n - F.expr(f"(n * {percent} + 99) div 100"))
    return placed.select("id", "component", "n", "token", "pos", (pos <= n - F.expr(f"(2 * n * {percent} + {99 + percent}) div {100 + percent}")).alias("short"))


def across(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids of different components among ``first_shingles`` that may have the similarity.

    Of each shingle the component with most rows is set apart: its own rows are never paired with each other, so the work
    is within a constant factor of the pairs of different components.
    """
    tally = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    top = tally.groupBy("token").agg(F.max(F.struct("k", "component"))["component"].alias("top"), F.count("*").alias("m")).where("m > 1").select("token", "top")
    rows = stored(rows.join(top, "token"))
    p, q = rows.where("component <> top").alias("p"), rows.alias("q")
    c = F.col
    later = (c("q.n") < c("p.n")) | ((c("q.n") == c("p.n")) & (c("q.id") < c("p.id")))
    small, large = F.least("p.n", "q.n"), F.greatest("p.n", "q.n")
    room = F.least(c("p.n") - c("p.pos"), c("q.n") - c("q.pos"))
    fits = (small * 100 >= large * percent) & (room * (100 + percent) >= (small + large) * percent)
    pairs = p.join(q, (c("p.token") == c("q.token")) & (c("p.component") != c("q.component")) & F.when(later, c("q.short")).otherwise(c("p.short")) & fits)
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).where("a < b").distinct()


def texts_of(documents: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) of the ids (one stored column doc_id): sent to the scan up to BROADCAST_IDS of them, else joined."""
    texts = documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, documents: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union.

    Only candidates' texts are read on: their ids go to the scan (up to BROADCAST_IDS of them) or are joined with it.
    """
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    if ids.isEmpty():
        return pairs
    sets = over_texts(texts_of(documents, ids, doc_id, text), {"doc_id": "doc_id", "text": "text"}, "doc_id bigint, members array<bigint>", lambda: lambda b: {"doc_id": b["doc_id"], "members": [x.view(np.int64) for x in shingle_sets(Words(b["text"], SPACED_LOWER), shingle)]})
    sets = stored(sets)
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    # the set of a document with many pairs, such as the first of a large group, is sent to several tasks
    hot = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("k")).where("k > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    k = F.coalesce("k", F.lit(1))
    salted = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.hash("b"), k).alias("salt"))
    left = left.join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), k - 1)).alias("salt"))
    both = salted.join(right, "b").join(left, ["a", "salt"])
    common = F.size(F.array_intersect("x", "y"))
    return both.where((common * 100) >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, bands: int | None = None, rows: int | None = None, sketch_distance: int | None = None, bucket_load: float = BUCKET_LOAD) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least doc_id linked with it) and kept (it is that one).

    percent: documents are linked from this Jaccard similarity on, in hundredths; bands, rows and sketch distances that are
    not given follow it.
    """
    if bands is None or rows is None:
        if bands is not None or rows is not None:
            raise ValueError("bands and rows are given together")
        bands, rows = banding(percent, permutations)
    if sketch_distance is None:
        sketch_distance = farthest(percent, min(SKETCH_BITS, 2 * permutations))
    signed = stored(signatures(documents, doc_id=doc_id, text=text, shingle=shingle, permutations=permutations, bands=bands, rows=rows))
    has = signed.where("n_shingles > 0 and doc_id is not null")
    # 1. equal sets
    first = F.min(F.struct("doc_id", "bands", "sketch_a", "sketch_b"))
    groups = stored(has.groupBy("set_a", "set_b").agg(first.alias("f")).select("set_a", "set_b", "f.*"))
    members = groups.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("sketch_a").alias("sa"), F.col("sketch_b").alias("sb"))
    close = lambda a, b: F.bit_count(F.col(f"{a}.sa").bitwiseXOR(F.col(f"{b}.sa"))) + F.bit_count(F.col(f"{a}.sb").bitwiseXOR(F.col(f"{b}.sb"))) <= sketch_distance
    # 2. each bucket's members with its least
    heads = members.groupBy("key").agg(F.min(F.struct("id", "sa", "sb")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", "h.*")
    m, h = members.alias("m"), heads.alias("h")
    stars = m.join(h, F.col("m.key") == F.col("h.key")).where((F.col("m.id") > F.col("h.id")) & close("m", "h"))
    stars = stored(stars.select(F.col("h.id").alias("a"), F.col("m.id").alias("b")).distinct())
    links = stored(confirmed(stars, documents, doc_id, text, shingle, percent))
    found = stored(components(links))
    # 3. what several components share a bucket
    labelled = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = stored(labelled.join(mixed_keys, "key", "left_semi").select(F.col("id").alias("doc_id"), "component").distinct())
    small = rest.count() <= BROADCAST_IDS
    texts = documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")).join(F.broadcast(rest) if small else rest, "doc_id")
    ids = rest.select("doc_id").distinct()
    met = signed.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    if met <= bucket_load * LEVEL_BUCKETS:
        firsts = first_shingles(texts, levels(texts, shingle), shingle, percent)
    else:
        firsts = first_shingles_exact(texts, shingle, percent)
    cross = stored(across(firsts, percent).join(stars, ["a", "b"], "left_anti"))
    more = stored(confirmed(cross, documents, doc_id, text, shingle, percent))
    if not more.isEmpty():
        found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    # rows of one id with different sets belong together
    classes = groups.select("set_a", "set_b", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_a", "set_b", F.coalesce("component", "doc_id").alias("component"))
    out = signed.join(classes, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_copies(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, that of the least id, with all columns; rows that share an id stay together.

    Only the ids that go are sent to the documents: broadcast up to BROADCAST_IDS of them, else joined.
    """
    (id_,) = free(documents.columns, "gone_")
    gone = stored(near_duplicates(documents, doc_id=doc_id, text=text, **options).where("not kept").select(F.col("doc_id").alias(id_)).distinct())
    small = gone.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(gone) if small else gone, F.col(quoted(doc_id)) == F.col(id_), "left_anti")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents, linked from a similarity of 0.85 on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
