"""Tallies over aligned rows: per-site counts and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.composition import SLOTS, base_counts, plurality_acgtn


def per_site_counts(df: DataFrame, seq: str, order: str) -> DataFrame:
    """(pos, eight counts) for each site of the first row by ``order``; longer rows are cut, shorter ones end early.

    The first row's length is found by one aggregation and joined as a single row; sites are counted with map-side combine.
    """
    first = df.agg(F.min_by(F.length(seq), order).alias("n")).first()["n"]
    if not first:
        return df.sparkSession.createDataFrame([], "pos int, " + ", ".join(f"{s} bigint" for s in SLOTS))
    sites = df.where(F.length(seq) > 0).select(F.posexplode(F.split(F.substring(seq, 1, first), "")).alias("pos", "base"))
    kinds = sites.groupBy("pos", "base").agg(F.count("*").alias("n"))
    slot = base_counts(F.col("base"))
    return kinds.groupBy("pos").agg(*[F.sum(slot[s] * F.col("n")).alias(s) for s in SLOTS])


def merged_counts(df: DataFrame, seq: str, *keys: str) -> DataFrame:
    """The eight counts of all rows (of each key) together."""
    c = base_counts(F.col(seq))
    return df.groupBy(*keys).agg(*[F.sum(c[s]).alias(s) for s in SLOTS])


def consensus(sites: DataFrame) -> DataFrame:
    """(pos, base): the plurality of each site; one row of text by ``consensus_text``."""
    return sites.select("pos", plurality_acgtn(F.struct(*[F.col(s) for s in SLOTS])).alias("base"))


def consensus_text(sites: DataFrame) -> DataFrame:
    """One row: the consensus as a string. As long as one sequence, so it fits where a sequence does."""
    return consensus(sites).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


def frequency_table(df: DataFrame, value: str, *keys: str, low: int = 0, high: int = 255) -> DataFrame:
    """(count, min, median, max) of the values in the range, exact, from a histogram of at most high - low + 1 bins a key."""
    bins = df.where(F.col(value).between(low, high)).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return bins.groupBy(*keys).agg(F.sum("n").alias("count"), F.min(value).alias("min"), F.expr(f"percentile(`{value}`, 0.5, n)").alias("median"), F.max(value).alias("max"))
