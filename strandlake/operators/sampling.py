"""Samplers. All draw by a hash of the row's key and the seed, so a sample is the same however rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of draws that a large sample's border is found by, and the size from which it is.
BINS, SORTED = 1 << 16, 100_000


def draw(key: str, seed: int) -> Column:
    """A number from 0 to below 1 for each key: the first 52 bits of the MD5 of ``seed:key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def bernoulli(df: DataFrame, key: str, p: float, seed: int = 42) -> DataFrame:
    """Each row with probability p."""
    if not 0 <= p <= 1:
        raise ValueError("p must be from 0 to 1")
    return df.where(draw(key, seed) < p)


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer: the n least draws, of equal ones those of the least keys.

    Small samples are a top n. For a large one rows are counted in bins of draws (65,536 counts), all rows of the bins below
    the n-th draw are taken where they lie, and only its own bin is sorted: no task holds n rows.
    """
    if n <= SORTED:
        return df.orderBy(draw(key, seed), key).limit(n)
    bin_ = F.floor(draw(key, seed) * BINS).cast("int")
    left, border = n, BINS
    for b, count in sorted(tuple(r) for r in df.groupBy(bin_.alias("b")).count().where("b is not null").collect()):
        if count > left:
            border = b
            break
        left -= count
    return df.where(bin_ < border).unionByName(df.where(bin_ == border).orderBy(draw(key, seed), key).limit(left))


def known_size(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows in the order of their keys; an error if there are fewer."""
    if n > (total := df.count()):
        raise ValueError(f"{n} rows asked for, {total} there")
    return reservoir(df, key, n, seed).orderBy(key)
