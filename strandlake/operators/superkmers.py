"""K-mers over packed numbers, counted from super-k-mers.

Neighbouring k-mers mostly have the same minimizer, the m-mer in them that an order puts first, so a run of them travels as one
piece of text (a super-k-mer) to where its minimizer's k-mers are counted: k - 1 bases once and one more for each k-mer, in place of a row of k
bases for each. All occurrences of a k-mer have one minimizer and meet there. Equal super-k-mers are counted before they travel.

There k-mers are cut out and counted as text (A, C, G, T; others become A), and each is packed to a two-bit code in a long only
after that, once and not at every occurrence. Minimizers with more than ``HOT_BASES`` go the other way: their k-mers are dealt by themselves, so no task holds
all of a frequent minimizer's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.kmers import MAX_TWO_BIT, encode, normal
from strandlake.sources.scratch import scratch

PACKED = 32
#: Windows of the pieces that sequences are cut into.
PIECE = 192
#: Bases of one minimizer that are counted in one task.
HOT_BASES = 64_000_000
#: Frequent minimizers are broadcast up to so many, else joined.
BROADCAST_BINS = 1_000_000


def least_of(values: Column, width: int) -> Column:
    """The least of each ``width`` neighbouring values, by doubling: each step takes the least of two windows that cover the next."""

    def step(stride: int):
        return lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - stride), lambda v, i: F.least(v, F.get(x, i + stride)))

    have = 1
    while have < width:
        stride = min(have, width - have)
        values = F.get(F.transform(F.array(values), step(stride)), F.lit(0))  # the array is bound once
        have += stride
    return values


def super_kmers(df: DataFrame, seq: str, k: int, m: int = 9) -> DataFrame:
    """(minimizer, bases): the maximal runs of neighbouring k-mers with one minimizer, as text; runs end at a piece's border too.

    The order of m-mers is that of their hash, so runs of one letter aren't preferred.
    """
    if not 1 <= m < k <= MAX_TWO_BIT:
        raise ValueError("m is shorter than k")
    base = df.select(normal(F.col(seq), 2).alias("s")).where(F.length("s") >= k)
    pieces = F.sequence(F.lit(0), F.floor((F.length("s") - k) / PIECE).cast("int"))
    at = base.select("s", F.explode(pieces).alias("p")).select(F.substr("s", F.col("p") * PIECE + 1, F.lit(PIECE + k - 1)).alias("s"))
    ranks = F.transform(F.sequence(F.lit(1), F.length("s") - m + 1), lambda i: F.xxhash64(F.substr("s", i, F.lit(m))))
    ranked = at.select("s", ranks.alias("ranks"))
    runs = ranked.select("s", least_of(F.col("ranks"), k - m + 1).alias("first"))
    begins = F.filter(F.sequence(F.lit(1), F.size("first")), lambda i: (i == 1) | (F.get("first", i - 1) != F.get("first", i - 2)))
    cut = runs.select("s", "first", begins.alias("begins"))
    each = F.transform("begins", lambda b, j: F.struct(F.get("first", b - 1).alias("minimizer"), F.substr("s", b, F.coalesce(F.get("begins", j + 1), F.size("first") + 1) - b + (k - 1)).alias("bases")))
    return cut.select(F.inline(each))


def counts(df: DataFrame, seq: str, k: int, m: int = 9, hot_bases: int = HOT_BASES) -> DataFrame:
    """(code, count) of all k-mers of up to 32 bases."""
    if k > PACKED:
        raise ValueError(f"k-mer length {k} has no packed number; up to {PACKED} bases fit")
    return texts(df, seq, k, m, hot_bases).select(encode(F.col("kmer"), 2).alias("code"), "count")


def texts(df: DataFrame, seq: str, k: int, m: int = 9, hot_bases: int = HOT_BASES) -> DataFrame:
    """(kmer, count). Super-k-mers are made once and written, as their minimizers are counted first."""
    spark = df.sparkSession
    path = scratch(spark)
    super_kmers(df, seq, k, m).groupBy("minimizer", "bases").agg(F.count("*").alias("times")).write.parquet(path)
    runs = spark.read.parquet(path)
    hot = runs.groupBy("minimizer").agg(F.sum(F.length("bases")).alias("n")).where(F.col("n") > hot_bases).select("minimizer").persist()
    n = hot.count()
    # a given number is kept: fewer tasks would suit the super-k-mers' bytes, but not the k-mers that come of them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, runs.rdd.getNumPartitions())

    def windows(x: DataFrame) -> DataFrame:
        at = x.select("minimizer", "bases", "times", F.explode(F.sequence(F.lit(1), F.length("bases") - (k - 1))).alias("at"))
        return at.select("minimizer", F.substr("bases", F.col("at"), F.lit(k)).alias("kmer"), "times")

    def met(x: DataFrame) -> DataFrame:  # dealt by minimizer already: no further shuffle
        return windows(x.repartition(tasks, "minimizer")).groupBy("minimizer", "kmer").agg(F.sum("times").alias("count")).select("kmer", "count")

    if not n:
        hot.unpersist()
        return met(runs)
    few = F.broadcast(hot) if n <= BROADCAST_BINS else hot
    frequent = windows(runs.join(few, "minimizer", "left_semi")).groupBy("kmer").agg(F.sum("times").alias("count"))
    return met(runs.join(few, "minimizer", "left_anti")).unionByName(frequent)


def kmer_counts(df: DataFrame, seq: str, k: int, m: int = 9, hot_bases: int = HOT_BASES) -> DataFrame:
    """(kmer, count) as the counter of strings gives it with two bits, for k from m + 1 to 32."""
    if k > PACKED:
        raise ValueError(f"k-mer length {k} has no packed number; up to {PACKED} bases fit")
    return texts(df, seq, k, m, hot_bases)
