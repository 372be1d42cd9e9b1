"""Letters of whole Arrow batches: the same as by expressions, letter by letter, for odd texts too."""

import random
import statistics

from pyspark.sql import functions as F

from strandlake.functions import batches
from strandlake.functions import composition as cp
from strandlake.functions import sequence as sq
from strandlake.functions.alphabets import RECODE, REFINE, ByteMap

RND = random.Random(7)
TEXTS = [None, "", "A", "acgu", "é", "Aé中\U0001f600N", "---A-A...NNN", *["".join(RND.choices("ACGTUNacgtunRYkm.-:~ !xé中", k=RND.randrange(60))) for _ in range(60)]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")


def test_maps_as_expressions(spark):
    maps = {**{f"recode_{k}": m for k, m in RECODE.items()}, **{f"refine_{k}": m for k, m in REFINE.items()}, "some": ByteMap().map("ab", "xy").map_to_one("c", ""), "none": ByteMap("")}
    got = texts(spark).select("t", *[F.struct(batches.mapped(F.col("t"), m), m.apply(F.col("t"))).alias(k) for k, m in maps.items()])
    assert plan(got).count("ArrowEvalPython ") <= 2  # all maps of a batch together
    for r in got.collect():
        assert all(r[k][0] == r[k][1] for k in maps), r


def test_translations_as_codons(spark):
    t = F.col("t")
    got = texts(spark).select("t", sq.translate(t).alias("a"), sq.translate(t, exact=True).alias("b"), sq.translate_overlapping(t).alias("c"), sq.find_next_aa(t, "X").alias("d"))
    assert "transform(" not in plan(got)
    codons = texts(spark).select(F.array_join(F.transform(sq.codons(F.upper(t)), lambda c: sq.translate_codon(c, "~")), "").alias("b"))
    windows = texts(spark).select(F.array_join(F.transform(F.regexp_extract_all(F.upper(t), F.lit("(?s)(?=(...))"), F.lit(1)), lambda c: sq.translate_codon(c)), "").alias("c"))
    for r, b, c in zip(got.collect(), codons.collect(), windows.collect(), strict=True):
        assert (r["b"], r["c"]) == (b["b"], c["c"]), r
        assert r["t"] is None or r["a"] == r["b"] + "~" * (len(r["t"]) % 3 > 0) and r["d"] == (r["c"].find("X") if "X" in r["c"] else None), r


def test_scores_as_lists(spark):
    t = F.col("t")
    got = texts(spark).select("t", cp.min_q(t).alias("min"), cp.max_q(t).alias("max"), cp.median_q(t).alias("median"), cp.geometric_mean_q(t).alias("mean"), cp.arithmetic_mean_q(t).alias("error"))
    assert "transform(" not in plan(got) and plan(got).count("ArrowEvalPython ") <= 2
    for r in got.collect():
        q = [ord(c) - 33 for c in r["t"] or ""]
        if not q:
            assert list(r)[1:] == [None] * 5
            continue
        assert (r["min"], r["max"], r["median"]) == (min(q), max(q), statistics.median(q)), r
        assert abs(r["mean"] - statistics.fmean(q)) < 1e-2
