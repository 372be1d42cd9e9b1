"""The unlabelled risk of the toxicity model is that of all documents, whatever the sample."""

import math
import random

import numpy as np
import pyarrow as pa

from strandlake.llm import toxicity


def tables(spark, n=3000):
    """Documents of common words, some with rude ones, and of a rare clean source whose words half of the rude have too."""
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic, rare = i % 10 == 0, i % 20 == 7
        words = [f"plain{rnd.randrange(200)}" for _ in range(30)]
        words += [f"rude{rnd.randrange(5)}" for _ in range(rnd.randrange(0, 3))] if toxic else []
        words += ["harbour", "vessel"] if rare or toxic and rnd.random() < 0.5 else []
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_a_small_sample_comes_near_all_rows(spark):
    docs, labels = tables(spark)
    whole = toxicity.train(docs, labels, rounds=0)
    plain = toxicity.train(docs, labels, max_unlabelled=60, rounds=0)
    shifted = toxicity.train(docs, labels, max_unlabelled=60)
    scores = lambda m: np.array([r["score"] for r in toxicity.score(docs, m).orderBy("doc_id").collect()])
    want, without, with_all = scores(whole), scores(plain), scores(shifted)
    assert np.abs(with_all - want).mean() < 0.5 * np.abs(without - want).mean()


def test_all_rows_in_the_sample_shift_nothing(spark):
    rnd = np.random.default_rng(6)
    u = rnd.integers(0, 3, (500, 4)).astype(float)
    x = [np.array([(j, n) for j, n in enumerate(row) if n], "<i4").reshape(-1, 2).tobytes() for row in u.astype(int).tolist()]
    rows = spark.createDataFrame([(bytearray(b),) for b in x], "x binary").repartition(3)
    model = toxicity.Model(np.arange(4), rnd.normal(size=4), -1.0)
    shift = toxicity.shift_to_all(rows, model, u)
    assert np.abs(shift.slope).max() < 1e-5 and abs(shift.level) < 1e-5
    # against a part of the rows, shifted sums are those of all
    part = toxicity.shift_to_all(rows, model, u[:50])
    all_ = toxicity.slope(model.weights, model.bias, np.zeros((1, 4)), np.log1p(u), 1e-9)
    few = toxicity.slope(model.weights, model.bias, np.zeros((1, 4)), np.log1p(u[:50]), 1e-9, part)
    assert np.allclose(all_, few, atol=1e-5)


def test_partitions_do_not_matter(spark):
    docs, labels = tables(spark, 600)
    a, b = (toxicity.train(docs.repartition(k), labels, max_unlabelled=50) for k in (1, 7))
    assert a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def test_number_of_features_is_a_parameter(spark):
    docs, labels = tables(spark, 600)
    assert len(toxicity.train(docs, labels, features=2).chosen) == 2


def test_sums_over_rows():
    rnd = np.random.default_rng(3)
    rows = [sorted((int(i), int(rnd.integers(1, 9))) for i in rnd.choice(6, k, replace=False)) for k in (0, 3, 6, 1, 0)]
    at = rnd.normal(size=7)
    slope, loss = [0.0] * 7, 0.0
    for row in rows:
        f = at[6] + sum(at[i] * math.log(1 + n) for i, n in row)
        g = 1 / (1 + math.exp(-f))
        for i, n in row:
            slope[i] += g * math.log(1 + n)
        slope[6] += g
        loss += math.log(1 + math.exp(f))
    got = toxicity.loss_sums(pa.array([np.array(r, "<i4").tobytes() for r in rows], pa.binary()), at)
    assert np.allclose(got[:-1] / toxicity.UNIT, [*slope, loss], atol=1e-5) and got[-1] == 5
    assert toxicity.loss_sums(pa.array([], pa.binary()), at).tolist() == [0] * 9


def test_slope_with_a_shift():
    rnd = np.random.default_rng(8)
    p, u = rnd.random((9, 3)), rnd.random((12, 3))
    seen = set()
    for level in (0.0, -5.0):
        shift = toxicity.Shift(rnd.normal(size=4), rnd.normal(size=4), level)
        at = rnd.normal(size=4)
        parts = lambda x: toxicity.risk(x[:-1], x[-1], p, u, 0.3, shift)  # noqa: E731, B023
        under = parts(at)[1] < 0
        seen.add(under)
        value = lambda x: -parts(x)[1] if under else sum(parts(x))  # noqa: E731, B023
        steps = [(value(at + d) - value(at - d)) / 2e-6 for d in 1e-6 * np.eye(4)]
        assert np.allclose(toxicity.slope(at[:-1], at[-1], p, u, 0.3, shift), steps, atol=1e-5)
    assert seen == {True, False}
