"""The order of shingles by exact counts, and links just above the similarity."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import near_duplicates as nd


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def prose(rnd, n, vocabulary=10**6):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) or frozenset([tuple(w)] if w else [])


def alike(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def test_exact_counts_find_every_pair(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(10):
        base = prose(rnd, rnd.randint(6, 150))
        for _ in range(10):
            w = base[: rnd.randint(max(5, int(len(base) * 0.75)), len(base))]
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"y{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    docs = documents(spark, rows)
    for percent in (80, 85, 100):
        expected = {(a, b) for b in range(len(sets)) for a in range(b) if alike(sets[a], sets[b], percent)}
        first = nd.first_shingles_exact(docs.select("doc_id", "text", F.col("doc_id").alias("component")), 5, percent)
        assert expected and expected <= {tuple(r) for r in nd.across(first, percent).collect()}
        table = nd.first_shingles(docs.select("doc_id", "text", F.col("doc_id").alias("component")), nd.levels(docs, 5), 5, percent)
        count = lambda df: sorted((r["id"], r["n"], r["c"], r["s"]) for r in df.groupBy("id", "n").agg(F.count("*").alias("c"), F.count_if("short").alias("s")).collect())
        assert count(first) == count(table)  # places of both kinds are as many


def test_forms_by_exact_counts(spark):
    """1,500 filled-in forms: with a table as full as 10^8 shingles make it all of them meet, by exact counts almost none."""
    rnd = random.Random(6)
    form = " ".join(f"f{i}" for i in range(104))
    rows = [(i, form + " " + " ".join(f"d{i}x{j}" for j in range(16))) for i in range(1500)]
    rows += [(1500, rows[77][1] + " more"), (1501, rows[900][1].replace("d900x15", "changed")), (1501, rows[900][1].replace("d900x15", "changed"))]
    rows += [(2000 + i, " ".join(prose(rnd, 100))) for i in range(200)]
    docs = documents(spark, rows)
    first = nd.first_shingles_exact(docs.select("doc_id", "text", F.col("doc_id").alias("component")), 5, 85)
    assert nd.across(first, 85).count() < 100
    got = [{r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, bucket_load=load).collect()} for load in (0, nd.BUCKET_LOAD)]
    assert got[0] == got[1] and {d: c for d, c in got[0].items() if d != c} == {1500: 77, 1501: 900}


@pytest.mark.parametrize("load", [0, nd.BUCKET_LOAD])
def test_links_just_above_the_similarity(spark, load):
    """Pairs planted between 0.85 and 0.90 are all found."""
    rnd = random.Random(12)
    rows, planted = [], 0
    while planted < 250:
        w = prose(rnd, rnd.randint(60, 300), 5000)
        x = list(w)
        for _ in range(rnd.randint(1, 6)):
            x[rnd.randrange(len(x))] = f"z{rnd.randrange(10**6)}"
        a, b = shingles(" ".join(w)), shingles(" ".join(x))
        if alike(a, b, 85) and not alike(a, b, 90):
            rows += [(2 * planted, " ".join(w)), (2 * planted + 1, " ".join(x))]
            planted += 1
    got = nd.near_duplicates(documents(spark, rows), bucket_load=load).collect()
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got) and len(got) == 500
