"""Work that must not grow faster than the input: passes, shuffles, tasks and parts of plans."""

from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.operators import kmers as km
from strandlake.operators import sam as sm
from strandlake.operators import seeding as sd
from strandlake.operators import superkmers as sk
from strandlake.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_short_pairs_are_dealt_over_all_cores(spark):
    for name in ("align_short_local", "align_short_global", "pre_filter_never_rejects", "phmm_scores"):
        assert "RepartitionByExpression" in plan(QUERIES[name](spark, SMALL)), name


def test_both_ends_in_one_pass(spark):
    df = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTT"), (3, None)], "i int, s string")
    probe = spark.createDataFrame([("ACG",), ("CGT",)], "kmer string")
    got = km.find_ends(df, "i", "s", probe, 3)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 5, 8)]
    assert plan(QUERIES["kmer_first_and_last"](spark, SMALL)).count("documents") <= 1
    assert plan(QUERIES["kmer_first_and_last"](spark, SMALL)).count("doc_id#") and "FullOuter" not in plan(got) and plan(got).count("Join") == 1


def test_minimizers_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "ACGT" * 300)], "i int, s string")
    assert "Aggregate" not in plan(sd.minimizers(df, "i", "s", 8, 5))


def test_super_kmers_are_counted_as_text(spark):
    df = spark.createDataFrame([("ACGTN" * 50,), (None,)], "s string")
    got = sk.texts(df, "s", 31)
    assert "conv(" not in plan(got)
    assert dict(map(tuple, got.collect())) == dict(map(tuple, km.kmer_counts(df, "s", 31, bits=2).collect()))


def test_letters_are_mapped_once_a_piece(spark):
    text = plan(QUERIES["sql_kmers"](spark, SMALL))
    inner = text[text.index("named_struct(pos") :] if "named_struct(pos" in text else text[text.index("pos, cast(") :]
    assert "regexp_replace" not in inner[:200], text


def test_sorted_parts_follow_the_input(spark):
    rows = [(str(i), "N" if i % 3 else "*", i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "qname string, rname string, pos int").repartition(5)
    out = sm.coordinate_sort(df, spark.createDataFrame([("N", 0)], "rname string, idx int"))
    assert f"{5 * sm.SORTED_PARTS}" in plan(out).split("RepartitionByExpression")[1].splitlines()[0]
    got = [tuple(r) for r in out.collect()]
    assert got == sorted(rows, key=lambda r: (r[1] == "*", r[2], r[0]))


def test_gapped_rows(spark):
    rows = [("ACGTACGT", "TTACGGGA", "2S3M1I2D1M4H", 1), ("ACGT", "ACGT", "2M?2M", 0), ("AC", "AC", "99999999999999999999M2I", 0), ("ACGT", "AC", "5M1N1P1I", 3), (None, "A", "1M", 0), ("A", "A", "1M", None)]
    got = spark.createDataFrame(rows, "r string, q string, c string, s int").select(cg.aligned_pair(F.col("r"), F.col("q"), F.col("c"), F.col("s")).alias("p")).collect()
    assert [tuple(r["p"]) for r in got] == [("CGT-ACG", "ACGG--G"), ("AC", "AC"), ("--", ""), ("T-", "ACN"), (None, None), (None, None)]
    assert "ArrowEvalPython" in plan(spark.createDataFrame(rows, "r string, q string, c string, s int").select(cg.aligned_pair(F.col("r"), F.col("q"), F.col("c"), F.col("s"))))
