"""Packed k-mers, super-k-mers and searches with mismatches, against loops."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers as km
from strandlake.operators import mismatches as mm
from strandlake.operators import superkmers as sk


def bases(rnd, n, letters="ACGT"):
    return "".join(rnd.choice(letters) for _ in range(n))


def plain(s):
    return "".join(c if c in "ACGT" else "A" for c in (s or "").upper().replace("U", "T"))


def sequences(rnd):
    rows = [None, "", "A", "acgtun", "ACGT" * 100, "A" * 1000, "N" * 40]
    rows += [bases(rnd, n, "ACGTN" if n % 2 else "AC") for n in (8, 9, 10, 30, 31, 32, 33, 191, 192, 193, 222, 223, 224, 700, 3000)]
    return rows + rows[-3:]


@pytest.mark.parametrize(("k", "m"), [(2, 1), (10, 9), (31, 9), (32, 4)])
def test_counts_of_super_kmers(spark, k, m):
    rows = sequences(random.Random(k))
    expected = Counter()
    for s in map(plain, rows):
        expected.update(s[i : i + k] for i in range(len(s) - k + 1))
    df = spark.createDataFrame([(s,) for s in rows], "s string").repartition(3)
    for hot in (sk.HOT_BASES, 100):
        assert dict(tuple(r) for r in sk.kmer_counts(df, "s", k, m, hot).collect()) == expected


def test_least_of_neighbours(spark):
    rnd = random.Random(2)
    rows = [([rnd.randint(0, 99) for _ in range(n)],) for n in (23, 24, 60)]
    for width in (1, 2, 3, 8, 23):
        for r in spark.createDataFrame(rows, "x array<bigint>").select("x", sk.least_of(F.col("x"), width).alias("y")).collect():
            assert r["y"] == [min(r["x"][i : i + width]) for i in range(len(r["x"]) - width + 1)]
    with pytest.raises(ValueError):
        sk.counts(spark.createDataFrame([("A",)], "s string"), "s", 33)


def test_shuffled_bytes(spark, tmp_path):
    """At k = 31 the super-k-mers that travel have at most a fifth of the bytes of a row for each k-mer."""
    rnd = random.Random(3)
    df = spark.createDataFrame([(bases(rnd, 2000),) for _ in range(100)], "s string").repartition(4)
    runs = sk.super_kmers(df, "s", 31).agg(F.sum(F.length("bases") + 16), F.count("*")).first()
    rows = km.kmers(df, "s", 31, bits=2).agg(F.sum(F.length("kmer") + 16)).first()[0]
    assert runs[0] * 5 <= rows


def test_distances(spark):
    rnd = random.Random(4)
    for k in (2, 20, 21, 22, 42):
        rows = []
        for _ in range(60):
            a = bases(rnd, k, "NACGT")
            b = "".join(rnd.choice("NACGT") if rnd.random() < 0.3 else c for c in a)
            rows.append((a, b))
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", mm.mismatches(F.col("a"), F.col("b"), k).alias("n")).collect():
            assert r["n"] == sum(x != y for x, y in zip(r["a"], r["b"], strict=True))


@pytest.mark.parametrize(("k", "n", "equal"), [(6, 0, 1), (6, 1, 1), (9, 2, 2), (21, 3, 1), (21, 3, 2), (25, 2, 3)])
def test_near_kmers(spark, k, n, equal):
    rnd = random.Random(k * n)
    left = [bases(rnd, k, "NACGT") for _ in range(80)]
    right = [bases(rnd, k) for _ in range(30)]
    for a in left[:50]:
        b = list(a)
        for p in rnd.sample(range(k), rnd.randint(0, min(n + 1, k))):
            b[p] = rnd.choice("NACGT")
        right.append("".join(b))
    frames = [spark.createDataFrame([(x,) for x in [*t, t[0]]], "kmer string") for t in (left, right)]
    distance = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    expected = sorted((a, b, distance(a, b)) for a in set(left) for b in set(right) if distance(a, b) <= n)
    assert sorted(tuple(r) for r in mm.near(*frames, k, n, equal).collect()) == expected and expected


def test_find_within(spark):
    rnd = random.Random(9)
    rows = [(i, bases(rnd, 120)) for i in range(20)]
    wanted = [rows[3][1][40:52], "".join("A" if c != "A" else "C" for c in rows[5][1][7:8]) + rows[5][1][8:19], bases(rnd, 12)]
    got = mm.find_within(spark.createDataFrame(rows, "i int, s string"), "i", "s", spark.createDataFrame([(x,) for x in wanted], "kmer string"), 12, 3).collect()
    expected = sorted((i, a, a + 12, w, d) for i, s in rows for a in range(len(s) - 11) for w in set(wanted) if (d := sum(x != y for x, y in zip(w, s[a : a + 12], strict=True))) <= 3)
    assert sorted(tuple(r) for r in got) == expected


def test_blocks():
    for k in range(2, 30):
        for parts in range(1, k + 1):
            cut = mm.blocks(k, parts)
            assert [a for a, _ in cut] == [sum(n for _, n in cut[:i]) for i in range(parts)] and sum(n for _, n in cut) == k
    assert len(list(combinations(range(5), 2))) == 10
    with pytest.raises(ValueError):
        mm.blocks(3, 4)
