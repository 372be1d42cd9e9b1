"""Seeded random sequences.

``rand_sequence`` follows xoshiro256++ seeded by SplitMix64, as published by Blackman and Vigna: letter i is the upper half
of the i-th number modulo the alphabet's size, so a seed gives the same sequence everywhere. A table of sequences takes a
seed for each row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.shipping import ship

MASK = (1 << 64) - 1


def split_mix(seed: int):
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & MASK
        z = seed
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & MASK
        yield z ^ (z >> 31)


def xoshiro(seed: int):
    """The numbers of xoshiro256++."""
    turn = lambda x, k: (x << k | x >> (64 - k)) & MASK
    seeds = split_mix(seed)
    a, b, c, d = (next(seeds) for _ in range(4))
    while True:
        yield (turn((a + d) & MASK, 23) + a) & MASK
        t = b << 17 & MASK
        c ^= a
        d ^= b
        b ^= c
        a ^= d
        c ^= t
        d = turn(d, 45)


def rand_sequence(alphabet: str, length: int, seed: int) -> str:
    numbers = xoshiro(seed)
    return "".join(alphabet[(next(numbers) >> 32) % len(alphabet)] for _ in range(length))


def random_sequence(seed: Column, length: Column, alphabet: str = "ACGT") -> Column:
    """A sequence for each seed and length."""
    ship()

    @F.pandas_udf("string")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(k) else rand_sequence(alphabet, int(k), int(x)) for x, k in zip(s, n, strict=True)], dtype=object)

    return run(seed, length)


def random_sequences(spark: SparkSession, count: int, length: int, seed: int = 42, alphabet: str = "ACGT") -> DataFrame:
    """(id, sequence) of ``count`` rows; row i has the seed ``seed + i``."""
    return spark.range(count).select("id", random_sequence(F.col("id") + seed, F.lit(length), alphabet).alias("sequence"))
