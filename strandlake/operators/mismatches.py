"""K-mers within N mismatches of others, without their variants.

A k-mer has more than (4 k)^N / N! variants within N substitutions; none is made here. It is cut into ``N + equal`` blocks; N mismatches
leave at least ``equal`` of them as they are, so two k-mers within the distance agree in some choice of ``equal`` blocks. Each choice is a
key of an equi-join; what meets is verified by its packed numbers: the letters that differ are counted by one XOR.

More equal blocks give longer keys, so fewer meet in each, for more rows: N = 3 has 4 keys of one block, 10 of two, 20 of three.
A pair that agrees in several choices is taken at the first of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.kmers import encode, kmers


def blocks(k: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts, as even as can be."""
    if not 1 <= parts <= k:
        raise ValueError(f"{k} letters have no {parts} blocks")
    ends = [k * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def mismatches(a: Column, b: Column, k: int) -> Column:
    """How many letters of two k-mers over NACGT differ."""
    if k > 21:
        pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
        return F.size(F.filter(pairs, lambda x: x))
    x = encode(a).bitwiseXOR(encode(b))
    any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(any_bit.bitwiseAND(F.lit(int("001" * k, 2)).cast("bigint")))


def keys(kmer: Column, k: int, n: int, equal: int) -> Column:
    """(choice, key) for each choice of blocks: its number, and the blocks' letters one after another."""
    cut = blocks(k, n + equal)
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.concat(*[F.substring(kmer, cut[j][0] + 1, cut[j][1]) for j in c]).alias("key")) for i, c in enumerate(combinations(range(n + equal), equal))])


def near(left: DataFrame, right: DataFrame, k: int, n: int, equal: int = 2) -> DataFrame:
    """(a, b, mismatches) of every k-mer of the left frame (kmer) and each of the right within n substitutions, once a pair."""
    if n < 0 or equal < 1:
        raise ValueError("n is at least 0 and equal at least 1")
    a, b = (df.select("kmer").distinct().where(F.length("kmer") == k).select(F.col("kmer").alias(c), F.inline(keys(F.col("kmer"), k, n, equal))) for df, c in ((left, "a"), (right, "b")))
    met = a.join(b, ["choice", "key"])
    cut, choices = blocks(k, n + equal), list(combinations(range(n + equal), equal))
    same = [F.substring("a", at + 1, size) == F.substring("b", at + 1, size) for at, size in cut]
    # the first choice in which the two agree is that of their first equal blocks
    first = F.lit(len(choices))
    for i in reversed(range(len(choices))):
        agree = same[choices[i][0]]
        for j in choices[i][1:]:
            agree = agree & same[j]
        first = F.when(agree, F.lit(i)).otherwise(first)
    found = met.where(first == F.col("choice")).select("a", "b", mismatches(F.col("a"), F.col("b"), k).alias("mismatches"))
    return found.where(F.col("mismatches") <= n)


def find_within(df: DataFrame, id_: str, seq: str, collection: DataFrame, k: int, n: int, equal: int = 2) -> DataFrame:
    """(id, start, end, kmer, mismatches): every place whose k-mer is within n substitutions of one of the collection, with each of these."""
    places = kmers(df, seq, k, keep=(id_,))
    found = near(places.select("kmer"), collection, k, n, equal)
    hits = places.join(found.withColumnRenamed("a", "kmer"), "kmer")
    return hits.select(id_, F.col("pos").cast("bigint").alias("start"), (F.col("pos") + k).cast("bigint").alias("end"), F.col("b").alias("kmer"), "mismatches")
