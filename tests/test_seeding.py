"""Seeds, diagonals and chains against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import seeding as sd
from strandlake.operators.collinear import Many, best_chains


def bases(rnd, n, letters="ACGT"):
    return "".join(rnd.choice(letters) for _ in range(n))


def literal_minimizers(s, k, w, rank):
    kmers = [(rank(s[i : i + k]), i) for i in range(len(s) - k + 1)]
    windows = [kmers[i : i + w] for i in range(max(len(kmers) - w + 1, 1))] if kmers else []
    return {min(x)[1] for x in windows}


@pytest.mark.parametrize(("k", "w"), [(3, 4), (8, 5), (12, 1), (5, 40)])
def test_minimizers(spark, k, w):
    rnd = random.Random(k)
    rows = [(i, bases(rnd, n, "ACGTN" if i % 2 else "AT")) for i, n in enumerate([0, 1, k - 1, k, k + 1, k + w - 2, k + w - 1, k + w, 127, 128, 129, 140, 400, 1000])] + [(90, None)]
    import hashlib

    out = sd.minimizers(spark.createDataFrame(rows, "x int, s string"), "x", "s", k, w, F.md5).collect()
    for i, s in rows:
        got = sorted((r["pos"], r["seed"]) for r in out if r["id"] == i)
        assert got == sorted((p, s[p : p + k]) for p in literal_minimizers(s or "", k, w, lambda x: hashlib.md5(x.encode()).hexdigest()))


def tables(spark, rnd):
    refs = [(i, bases(rnd, rnd.randint(200, 900))) for i in range(30)]
    queries = []
    for i in range(40):
        _, r = refs[rnd.randrange(30)]
        a = rnd.randrange(len(r) - 120)
        q = list(r[a : a + 120])
        for _ in range(rnd.randint(0, 9)):
            p = rnd.randrange(len(q))
            q[p] = rnd.choice(["", "A", "CC", "G"])
        queries.append((i, bases(rnd, rnd.randint(0, 30)) + "".join(q) + bases(rnd, 20)))
    return queries, refs


def test_hits_and_diagonals(spark):
    queries, refs = tables(spark, random.Random(5))
    # a seed that every reference has many times is split over keys
    refs = [(i, s + "ACGTACGTACGT" * 12) for i, s in refs]
    queries[0] = (0, queries[0][1] + "ACGTACGTACGTACGT")
    k, w = 8, 5
    q, r = (sd.minimizers(spark.createDataFrame(t, "i int, s string"), "i", "s", k, w).persist() for t in (queries, refs))
    expected = sorted((a["id"], b["id"], a["pos"], b["pos"], b["pos"] - a["pos"]) for a in q.collect() for b in r.collect() if a["seed"] == b["seed"])
    for hot in (1000, 10, 1):
        assert sorted(tuple(x) for x in sd.hits(q, r, hot).collect()) == expected
    count = {}
    for a, b, _, _, d in expected:
        count[a, b, d] = count.get((a, b, d), 0) + 1
    best = {}
    for (a, b, d), n in count.items():
        best[a, b] = max(best.get((a, b), (0, 0)), (n, -d))
    assert sorted(tuple(x) for x in sd.diagonals(sd.hits(q, r)).collect()) == sorted((a, b, -d, n) for (a, b), (n, d) in best.items())


def test_every_shared_stretch_is_proposed(spark):
    queries, refs = tables(spark, random.Random(8))
    k, w = 10, 6
    frames = [sd.minimizers(spark.createDataFrame(t, "i int, s string"), "i", "s", k, w) for t in (queries, refs)]
    found = {(x["query"], x["ref"]) for x in sd.hits(*frames).select("query", "ref").distinct().collect()}
    n = w + k - 1
    for i, q in queries:
        parts = {q[a : a + n] for a in range(len(q) - n + 1)}
        assert all((i, j) in found for j, r in refs if any(r[a : a + n] in parts for a in range(len(r) - n + 1)))
    turned = sd.both_strands(spark.createDataFrame(queries[:3], "i int, s string"), "i", "s").collect()
    assert len(turned) == 6 and {x["strand"] for x in turned} == {"+", "-"}


def literal_chain(hits, k):
    done = []
    for r, q in sorted(set(hits)):
        options = [(k, -r, -q, 1)]
        for s, a, b, n, r1, q1 in done:
            dr, dq = r - r1, q - q1
            if dr > 0 and dq > 0:
                options.append((s + min(dr, dq, k) - abs(dr - dq) // 4, a, b, n + 1))
        done.append((*max(options), r, q))
    return max(done)


def test_chains(spark):
    rnd = random.Random(11)
    queries, refs = tables(spark, rnd)
    k, w = 7, 4
    frames = [sd.minimizers(spark.createDataFrame(t, "i int, s string"), "i", "s", k, w) for t in (queries, refs)]
    found = sd.hits(*frames).persist()
    pairs = {}
    for x in found.collect():
        pairs.setdefault((x["query"], x["ref"]), []).append((x["ref_pos"], x["query_pos"]))
    for (band, block) in ((1 << 20, 1 << 20), (64, 512)):
        got = {}
        for x in sd.chains(found, k, band, block).collect():
            got[x["query"], x["ref"]] = (x["score"], -x["ref_start"], -x["query_start"], x["n_seeds"], x["ref_end"] - k, x["query_end"] - k)
        expected = {}
        for pair, hs in pairs.items():
            groups = {}
            for r, q in hs:
                d = r - q
                for bd in ((2 * d) // band, (2 * d) // band - 1):
                    for bl in ((2 * r) // block, (2 * r) // block - 1):
                        groups.setdefault((bd, bl), []).append((r, q))
            expected[pair] = max(literal_chain(g, k) for g in groups.values())
        assert got == expected
    top = {x["query"]: x["score"] for x in sd.best_references(sd.chains(found, k)).collect()}
    assert top == {q: max(s for (a, _), (s, *_) in got.items() if a == q) for q in top} and len(top) == len({q for q, _ in pairs})


def scattered(rnd):
    """Hits of pairs: a gap of 300 diagonals, 21,000 bases of one diagonal, runs at any place, and repeats that hit everywhere."""
    far = [(12 * i, 12 * i) for i in range(60)] + [(1020 + 12 * i, 720 + 12 * i) for i in range(60)]
    long = [(300 * i, 300 * i) for i in range(70)]
    runs = {(r + 5 * i, q + 5 * i) for _ in range(9) for r, q in [(rnd.randrange(30000), rnd.randrange(900))] for i in range(rnd.randint(1, 12))}
    repeats = [(r, q) for r in range(40, 62) for q in range(0, 18)]
    return {("a", 1): far, ("a", 2): long, ("b", 1): sorted(runs), ("b", 2): repeats, ("c", 1): [(5, 7)], ("c", 3): [(5, 7), (5, 9), (6, 8)]}


def test_chains_over_whole_pairs(spark):
    k, pairs = 12, scattered(random.Random(4))
    found = spark.createDataFrame([(a, b, q, r, r - q) for (a, b), hs in pairs.items() for r, q in hs], "query string, ref int, query_pos int, ref_pos int, diag int")
    expected = {pair: literal_chain(hs, k) for pair, hs in pairs.items()}

    def of(df):
        return {(x["query"], x["ref"]): (x["score"], -x["ref_start"], -x["query_start"], x["n_seeds"], x["ref_end"] - k, x["query_end"] - k) for x in df.collect()}

    assert expected["a", 1][3] == 120 and expected["a", 2][3] == 70
    assert of(sd.chains(found, k)) == expected
    # pairs of many hits go through staircases, pairs of all sizes go on in other batches
    hits = found.select("query", "ref", F.col("ref_pos").alias("r"), F.col("query_pos").alias("q"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        for many in (0, 3, 80, 2048):
            assert of(best_chains(hits, ["query", "ref"], k, many)) == expected
    finally:
        spark.conf.set(size, before)
    assert sd.chains(found.where("false"), k).collect() == []


def test_chains_of_many_hits():
    rnd = random.Random(9)
    for _ in range(60):
        k, (m, n) = rnd.choice([1, 2, 5, 12]), rnd.choice([(6, 6), (30, 20), (400, 30), (30, 400), (90000, 300)])
        hs = {(rnd.randrange(m), rnd.randrange(n)) for _ in range(rnd.randint(1, 80))}
        hs |= {(r + 3 * i, q + 3 * i) for r, q in list(hs)[:3] for i in range(rnd.randint(1, 25))}
        pair = Many(k, max(q for _, q in hs))
        for r, q in sorted(hs):
            pair.add(r, q)
        s, a, b, c, r, q = literal_chain(hs, k)
        assert pair.result() == [s, c, -b, q + k, -a, r + k]
    # letters that all hit: what is held follows the query, not the hits
    pair, held = Many(8, 29), []
    for r in range(600):
        for q in range(30):
            pair.add(r, q)
        held.append(sum(len(x.at) for f in (*pair.columns.values(), *pair.tree.values(), pair.above) for x in f))
    assert max(held[300:]) <= 2 * max(held[:300])


def test_ungapped(spark):
    rnd = random.Random(3)
    rows = [(bases(rnd, rnd.randint(0, 12), "AC"), bases(rnd, rnd.randint(0, 12), "AC"), d) for d in range(-15, 16)]
    for r in spark.createDataFrame(rows, "a string, b string, d int").select("a", "b", "d", sd.ungapped(F.col("a"), F.col("b"), F.col("d")).alias("u")).collect():
        both = [(r["a"][i], r["b"][i + r["d"]]) for i in range(len(r["a"])) if 0 <= i + r["d"] < len(r["b"])]
        assert tuple(r["u"]) == (sum(x == y for x, y in both), len(both))
