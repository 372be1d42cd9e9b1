"""Trimming of reads as one native projection after another.

A trim restricts a range (start, end) of the read, so the sequence and the quality are cut once at the end, whatever the
number of steps. Steps are functions from (sequence, range) to a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.alphabets import char_class
from strandlake.operators.kmers import check_length, normal


def runs(base: str, least: int) -> Callable[[Column], list[Column]]:
    """Removes runs of a base of at least this length from both ends."""

    def step(s: Column) -> list[Column]:
        lead = F.length(F.regexp_extract(s, f"^{char_class(base)}*", 0))
        rest = F.length(s) - F.when(lead >= least, lead).otherwise(0)
        trail = F.length(F.regexp_extract(s, f"{char_class(base)}*\\z", 0))
        return [F.when(lead >= least, lead).otherwise(F.lit(0)), F.when((trail >= least) & (rest > 0), F.least(trail, rest)).otherwise(F.lit(0))]

    return step


def hard(n: int, m: int | None = None) -> Callable[[Column], list[Column]]:
    """Removes n bases from the start and m (else n) from the end, where more than both remain."""
    m = n if m is None else m

    def step(s: Column) -> list[Column]:
        enough = F.length(s) > n + m
        return [F.when(enough, n).otherwise(F.lit(0)), F.when(enough, m).otherwise(F.lit(0))]

    return step


def primer(kmers: list[str], within: int, bits: int = 3) -> Callable[[Column], list[Column]]:
    """Removes all up to the end of the last k-mer of a primer's set in the first ``within`` bases.

    kmers: the set's k-mers, all of one length (a primer's variants are a few hundred at most).
    """
    k = check_length(len(kmers[0]), bits)
    if any(len(x) != k for x in kmers):
        raise ValueError("the k-mers are of several lengths")

    def step(s: Column) -> list[Column]:
        region = normal(F.substring(s, 1, within), bits)
        windows = F.reverse(F.regexp_extract_all(region, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))
        at = F.array_position(F.transform(windows, lambda x: x.isin(kmers)), True)
        return [F.when(at > 0, F.size(windows) - at + k).otherwise(F.lit(0)), F.lit(0)]

    return step


def primer_kmers(sequence: str, k: int, mismatches: int = 0) -> list[str]:
    """A primer's k-mers and all their variants over NACGT within so many substitutions."""
    out = {sequence[i : i + k] for i in range(len(sequence) - k + 1)}
    for _ in range(mismatches):
        out |= {x[:i] + b + x[i + 1 :] for x in out for i in range(k) for b in "NACGT"}
    return sorted(out)


def trim(reads: DataFrame, steps: list[Callable[[Column], list[Column]]], *, sequence: str = "sequence", quality: str | None = "quality") -> DataFrame:
    """The reads with their sequence (and quality) trimmed by each step in turn, all other columns as they are."""
    taken = {c.lower() for c in reads.columns}
    cut, start, front, back = (next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in ("cut", "start", "front", "back"))
    out = reads.withColumn(cut, F.col(sequence)).withColumn(start, F.lit(0))
    for step in steps:
        a, b = step(F.col(cut))
        out = out.withColumn(front, a.cast("int")).withColumn(back, b.cast("int"))
        out = out.withColumn(cut, F.substring(F.col(cut), F.col(front) + 1, F.length(cut) - F.col(front) - F.col(back))).withColumn(start, F.col(start) + F.col(front))
    if quality is not None:
        out = out.withColumn(quality, F.substring(F.col(quality), F.col(start) + 1, F.length(cut)))
    return out.withColumn(sequence, F.col(cut)).select(*reads.columns)
