"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, whatever its label, is unlabelled. A linear model over hashed
words and beginnings of words (4 to 8 bytes, so that inflected and compounded forms share one) is fitted with numpy by the
class-prior-corrected risk ``p R+(P) + max(0, R-(U) - p R-(P))`` with the logistic loss: where the bracket falls below zero
the step goes back along it instead. The class prior ``p`` is a parameter, or the share of toxic rows among the labelled
ones of the training folds.

Which of the hashed features matter is counted over all documents of the training folds: the shares of documents with each
of ``buckets`` features, by a sum in each task and one over the tasks. Features whose shares among the positives and all
documents differ by chance alone get no weight. The gradient steps on the driver use at most ``max_positive`` confirmed
documents and ``max_unlabelled`` others, chosen by a hash of their ids, of which only the chosen features' counts come to
the driver. Those others only give the shape of the risk: its level and its slope are those of all documents of the training
folds, by sums over them at the weights found so far (a surrogate loss, as in communication-efficient estimation), in
``rounds`` rounds of one number a feature. The sums are of fixed-point numbers, so their order doesn't matter. Scores are
computed for every whole text where it lies.

Cases: null and empty texts get the score of a text without known features; without confirmed rows every score is the prior;
rows that repeat an id are scored each and each is in the sums over all documents, and one of them is in the sample, the one of the least hash; labels that repeat an id
count as the greatest; equal texts get equal scores; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._labels import first_by_hash, fold, labelled, one_a_document
from strandlake.llm._spark import written
from strandlake.llm._text import _BYTES, ALNUM_LOWER, Words, chunks, over_texts, prepare, quoted, spans_hash

BUCKETS, MAX_POSITIVE, MAX_UNLABELLED, FEATURES = 1 << 18, 4000, 8000, 400
#: Sums over all documents for the unlabelled risk, and the unit of their fixed-point numbers.
ROUNDS, UNIT = 2, 1 << 20
#: Bytes of the beginnings of longer words.
BEGINNINGS = (4, 5, 6, 7, 8)


def bags(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct hashed words and beginnings of all rows, sorted."""
    rows, hashes = [words.row], [words.hash]
    for k in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > k)
        rows.append(words.row[long])
        hashes.append(spans_hash(words.data, words.start[long], words.start[long] + k, _BYTES) ^ np.uint64(k << 32 | k))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    key, n = np.unique(row.astype(np.int64) * buckets + (h & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
    return key // buckets, key % buckets, n


class Model:
    """A linear model over chosen buckets."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def score(self, words: Words, buckets: int) -> np.ndarray:
        value = np.zeros(buckets, np.float64)
        value[self.chosen] = self.weights
        row, bucket, n = bags(words, buckets)
        total = np.bincount(row, value[bucket] * np.log1p(n), minlength=len(words.count)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def choose(positive: np.ndarray, n_positive: int, every: np.ndarray, n: int, features: int = FEATURES) -> np.ndarray:
    """The buckets whose shares of the positives and of all documents differ most, beyond chance; given are counts of documents."""
    if not n_positive or not n:
        return np.zeros(0, np.int64)
    a, b = positive / n_positive, every / n
    mean = (positive + every) / (n_positive + n)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n_positive + 1 / n))
    z = np.abs(a - b) / np.maximum(spread, 1e-9)
    chosen = np.sort(np.argsort(-z, kind="stable")[:features])
    return chosen[z[chosen] > 5]


class Shift:
    """What all documents' loss as negatives has more than the sample's, to first order around ``at`` (weights, then bias)."""

    def __init__(self, at: np.ndarray, slope: np.ndarray, level: float) -> None:
        self.at, self.slope, self.level = at, slope, level

    def value(self, w: np.ndarray, bias: float) -> float:
        return self.level + float(self.slope @ (np.r_[w, bias] - self.at))


def risk(w: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float, shift: Shift | None = None) -> tuple[float, float]:
    """The two parts of the risk: of positives as such, and the bracket, of unlabelled rows as negatives less the positives'
    share. The logistic loss is log(1 + e^-f) for a positive and log(1 + e^f) for a negative."""
    fp, fu = p @ w + bias, u @ w + bias
    more = shift.value(w, bias) if shift is not None else 0.0
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() + more - prior * np.logaddexp(0, fp).mean()


def slope(w: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float, shift: Shift | None = None) -> np.ndarray:
    """The step's gradient, the bias last: of the whole risk, or against the bracket where that is negative."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    fp, fu = p @ w + bias, u @ w + bias
    gp, gu, gn = -prior * sigmoid(-fp) / len(fp), sigmoid(fu) / len(fu), -prior * sigmoid(fp) / len(fp)
    sign = 1 if risk(w, bias, p, u, prior, shift)[1] >= 0 else -1
    by_p, by_u = gp + gn if sign > 0 else -gn, sign * gu
    out = np.r_[p.T @ by_p + u.T @ by_u, by_p.sum() + by_u.sum()]
    return out if shift is None else out + sign * shift.slope


def fit(p: np.ndarray, u: np.ndarray, chosen: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, shift: Shift | None = None) -> Model:
    """p, u: counts of the chosen features of the positive and the unlabelled documents, a row each."""
    log_odds = float(np.log(prior / (1 - prior)))
    if not len(p) or not len(u):
        return Model(np.zeros(0, np.int64), np.zeros(0), log_odds)
    p, u = np.log1p(p), np.log1p(u)
    at, first, second = np.r_[np.zeros(len(chosen)), log_odds], np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        grad = slope(at[:-1], at[-1], p, u, prior, shift) + np.r_[decay * at[:-1], 0]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        at = at - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(chosen, at[:-1], float(at[-1]))


def loss_sums(x: pa.Array, at: np.ndarray) -> np.ndarray:
    """Of rows as negatives: the slope by each weight and the bias, the loss, in fixed-point numbers; and how many rows."""
    features = len(at) - 1
    row = np.repeat(np.arange(len(x)), [len(b) // 8 for b in x.to_pylist()])
    place, n = np.frombuffer(b"".join(x.to_pylist()), "<i4").reshape(-1, 2).T
    value = np.log1p(n)
    f = np.bincount(row, at[place] * value, minlength=len(x)) + at[-1]
    sigmoid = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    by_place = np.bincount(place, np.rint(sigmoid[row] * value * UNIT), minlength=features)
    return np.r_[by_place, np.rint(sigmoid * UNIT).sum(), np.rint(np.logaddexp(0, f) * UNIT).sum(), len(x)].astype(np.int64)


def shift_to_all(rows: DataFrame, model: Model, u: np.ndarray) -> Shift:
    """The shift at a model's weights from the sample u (counts) to all rows of x, by one aggregation."""
    at = np.r_[model.weights, model.bias]

    def add(batches):
        total = np.zeros(len(at) + 2, np.int64)
        for batch in batches:
            total += loss_sums(batch["x"], at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "n"])

    sums = rows.select("x").mapInArrow(add, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # three rows more than features
    total = np.zeros(len(at) + 2)
    total[sums["place"].to_numpy()] = sums["n"].to_numpy()
    all_ = total[:-1] / UNIT / max(total[-1], 1)
    f = np.log1p(u) @ model.weights + model.bias
    sigmoid = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    return Shift(at, all_[:-1] - np.r_[np.log1p(u).T @ sigmoid, sigmoid.sum()] / len(u), float(all_[-1] - np.logaddexp(0, f).mean()))


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, buckets: int = BUCKETS, features: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """The model from all folds but ``held_out``."""
    known = labelled(labels, doc_id, label).where(fold("doc_id", folds) != held_out)
    if prior is None:
        n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        prior = (ones + 1) / (n + 20)
    p = first_by_hash(known.where("y = 1").select("doc_id"), max_positive)  # bounded by max_positive
    text_ = F.col(quoted(text))
    docs = documents.select(F.col(quoted(doc_id)).alias("doc_id"), text_.alias("text"), F.xxhash64(F.coalesce(text_, F.lit(""))).alias("tag")).where("doc_id is not null").where(fold("doc_id", folds) != held_out)
    docs = docs.join(F.broadcast(p.withColumn("p", F.lit(1))), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(0)))

    def count(batches):
        every, positive, n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), [0, 0]
        for batch in batches:
            for part in chunks(batch, "text"):
                row, bucket, _ = bags(Words(part["text"], ALNUM_LOWER), buckets)
                marked = part["p"].to_numpy() == 1
                every += np.bincount(bucket, minlength=buckets)
                if marked.any():
                    positive += np.bincount(bucket[marked[row]], minlength=buckets)
                n = [n[0] + part.num_rows, n[1] + int(marked.sum())]
        some = np.flatnonzero(every)
        out = (np.r_[-1, some].astype(np.int32), np.r_[n[0], every[some]], np.r_[n[1], positive[some]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", "n", "p"])

    prepare(documents.sparkSession)
    counts = docs.select("text", "p").mapInArrow(count, "bucket int, n bigint, p bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()  # buckets + 1 rows at most
    at, totals = counts["bucket"].to_numpy(), np.zeros((2, buckets + 1), np.int64)
    for i, c in enumerate(("n", "p")):
        totals[i, at + 1] = counts[c].to_numpy()
    chosen = choose(totals[1, 1:], int(totals[1, 0]), totals[0, 1:], int(totals[0, 0]), features)

    def work():
        place = np.full(buckets, -1, np.int64)
        place[chosen] = np.arange(len(chosen))

        def f(batch: pa.RecordBatch) -> dict:
            row, bucket, n = bags(Words(batch["text"], ALNUM_LOWER), buckets)
            known = place[bucket] >= 0
            pairs = np.stack((place[bucket[known]], n[known]), 1).astype("<i4").tobytes()
            ends = np.r_[0, np.cumsum(np.bincount(row[known], minlength=batch.num_rows))] * 8
            x = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pairs)])
            return {"doc_id": batch["doc_id"], "tag": batch["tag"], "p": batch["p"], "u": batch["u"], "x": x}

        return f

    u = first_by_hash(docs.select("doc_id").distinct(), max_unlabelled).withColumn("u", F.lit(1))  # bounded by max_unlabelled
    rows = docs.join(F.broadcast(u), "doc_id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    rows = written(over_texts(rows, {k: k for k in ("doc_id", "tag", "text", "p", "u")}, "doc_id bigint, tag bigint, p int, u int, x binary", work))
    kept = sorted(one_a_document(rows.where("p = 1 or u = 1"), "p", "u", "x").collect())  # a row for each chosen id, of features that are not 0
    x = np.zeros((len(kept), len(chosen)))
    for i, r in enumerate(kept):
        pairs = np.frombuffer(r["x"], "<i4").reshape(-1, 2)
        x[i, pairs[:, 0]] = pairs[:, 1]
    p, u = (x[np.array([r[k] == 1 for r in kept], bool)] for k in ("p", "u"))
    prior = min(max(prior, 1e-4), 0.9)
    model = fit(p, u, chosen, prior)
    for _ in range(rounds if len(chosen) and len(p) and len(u) else 0):
        model = fit(p, u, chosen, prior, shift=shift_to_all(rows, model, u))
    return model


def score(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id and score of each document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def work():
        return lambda batch: {"doc_id": batch["doc_id"], "score": held.value.score(Words(batch["text"], ALNUM_LOWER), buckets)}

    return over_texts(documents, {"doc_id": doc_id, "text": text}, "doc_id bigint, score double", work)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model that has seen no label of fold 0."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(documents, train(documents, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
