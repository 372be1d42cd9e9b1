"""Site counts by key, running counts of a stream, native cursors of alignments, and the stable sort."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions.composition import SLOTS
from strandlake.operators import kmers as km
from strandlake.operators import sam as sm
from strandlake.operators import sites
from strandlake.sources.sam import read_sam

LETTERS = {"a": "Aa", "c": "Cc", "g": "Gg", "t": "TtUu", "n": "Nn", "gap": "-", "other": "RYSWKMBDHVryswkmbdhv."}


def bases(rnd, n, letters="ACGTacgtuN-RY.!"):
    return "".join(rnd.choice(letters) for _ in range(n))


def slot(c):
    return next((s for s, x in LETTERS.items() if c in x), "invalid")


def literal(rows):
    out = Counter()
    for k, s in rows:
        for i, c in enumerate(s or ""):
            out[k, i, slot(c)] += 1
    return out


def test_site_counts(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), bases(rnd, rnd.randint(0, 40))) for _ in range(200)] + [("a", None), ("c", ""), ("d", bases(rnd, 3000))]
    df = spark.createDataFrame(rows, "k string, s string").repartition(5)
    expected = literal(rows)
    for block in (7, 1024):
        got = {(r["k"], r["pos"], s): r[s] for r in sites.site_counts(df, "s", "k", block).collect() for s in SLOTS if r[s]}
        assert got == dict(expected)
    assert sites.site_counts(df.limit(0), "s", "k").count() == 0
    text = {}
    for r in sites.consensus(spark.createDataFrame([("x", "ACGT"), ("x", "ACCT"), ("x", "AGCTA"), ("y", "GG")], "k string, s string"), "s", "k", 2).collect():
        text.setdefault(r["k"], []).append((r["block"], r["bases"]))
    assert {k: "".join(b for _, b in sorted(v)) for k, v in text.items()} == {"x": "ACCTA", "y": "GG"}


def test_running_counts_restart(spark, tmp_path):
    rnd = random.Random(2)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every, seen = [], {}
    try:
        for run in range(3):
            rows = [(rnd.choice("ab"), bases(rnd, rnd.randint(1, 30))) for _ in range(40)]
            every += rows
            spark.createDataFrame(rows, "k string, s string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = sites.running_counts(spark.readStream.schema("k string, s string").parquet(f"{tmp_path}/in"), "s", "k", 8)

            def keep(batch, _):
                for r in batch.collect():
                    seen[r["key"], r["block"]] = r["counts"]

            q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            got = {(k, b * 8 + i, s): c[i * 8 + j] for (k, b), c in seen.items() for i in range(8) for j, s in enumerate(SLOTS) if c[i * 8 + j]}
            assert got == dict(literal(every)), run
    finally:
        spark.conf.unset(name)


def paired(ref, query, cigar, start):
    r, q, a, b = start, 0, [], []
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=XDN":
            a.append(ref[r : r + n])
            r += n
        elif op == "I":
            a.append("-" * n)
        if op in "M=XI":
            b.append(query[q : q + n])
        elif op in "DN":
            b.append(("-" if op == "D" else "N") * n)
        q += n * (op in "M=XIS")
    return "".join(a), "".join(b)


def test_native_pairs(spark):
    rnd = random.Random(3)
    rows = [("ACGT", "ACGT", "", 0), ("", "", "3M", 0), ("ACGT", "AC", "2S9M", 1), (None, "A", "1M", 0), ("A", None, "1M", 0), ("A", "A", None, 0), ("A", "A", "1M", None), ("ACGT", "ACGT", "2M0I2M", 0)]
    for _ in range(200):
        ops = [(rnd.randint(1, 6), rnd.choice("MIDNSHP=X")) for _ in range(rnd.randint(0, 40))]
        rows.append((bases(rnd, 150), bases(rnd, 150), "".join(f"{n}{o}" for n, o in ops), rnd.randint(0, 5)))
    pair = cg.aligned_pair(F.col("r"), F.col("q"), F.col("c"), F.col("s"))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x struct<r: string, q: string, c: string, s: int>").select("i", "x.*").select("i", pair.alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        x = rows[r["i"]]
        assert tuple(r["p"]) == (paired(*x) if None not in x else (None, None))


def test_prefix_sums(spark):
    rnd = random.Random(4)
    rows = [([rnd.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 100, 5000)]
    for r in spark.createDataFrame(rows, "x array<bigint>").select("x", cg.prefix_sums(F.col("x")).alias("p")).collect():
        assert r["p"] == [sum(r["x"][:i]) for i in range(len(r["x"]) + 1)]


def test_equal_records_keep_their_order(spark, tmp_path):
    rnd = random.Random(5)
    for f in ("a", "b"):
        lines = [f"q{rnd.randint(0, 2)}\t0\t{rnd.choice(['r1', 'r2', 'zz', '*'])}\t{rnd.randint(1, 3)}\t60\t1M\t*\t0\t0\tA\t*\tXX:Z:{f}{i:05d}" for i in range(3000)]
        (tmp_path / f"{f}.sam").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        references = spark.createDataFrame([("r2", 0), ("r1", 1)], "rname string, idx int")
        rows = read_sam(spark, str(tmp_path), ordinal="place")
        out = sm.coordinate_sort(rows.withColumn("idx", F.lit("kept")), references, "place").select("rname", "pos", "qname", "opt_fields", "idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kind = {"r2": 0, "r1": 1, "zz": 2, "*": 3}
    got = [(kind[r["rname"]], r["pos"], r["qname"], r["opt_fields"][0]) for r in out]
    assert got == sorted(got) and len(got) == 6000 and {r["idx"] for r in out} == {"kept"}
    same = spark.range(3000).select(F.lit("q").alias("qname"), F.lit("r1").alias("rname"), F.lit(1).alias("pos"), "id").repartition(1)
    assert [r["id"] for r in sm.coordinate_sort(same, references).collect()] == [r["id"] for r in same.collect()]


def test_kept_columns_of_any_name(spark):
    df = spark.createDataFrame([("ACGT", 1, 2, 3, 4)], "s string, _n int, _cut int, _at int, _pos int")
    got = km.kmers(df, "s", 3, keep=("_n", "_cut", "_at", "_pos")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 4, 0, "ACG"), (1, 2, 3, 4, 1, "CGT")]
