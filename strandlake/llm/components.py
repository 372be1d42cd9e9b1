"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step links nodes to the least neighbour seen, so long chains shrink in a number of rounds that grows with their
logarithm. Edges stay in DataFrames; each round is cut with a checkpoint. A node with many neighbours is met only in
aggregations by key (``min``) and in joins of edges with one row a node, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored


def digest(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: its size and two 64-bit sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge: component is the least node it is linked with, itself included.

    Edges have no direction; loops, repeats and nulls are left out.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now = stored(now)
    mark = digest(now)
    while True:
        # large star: each neighbour above a node moves to the node's least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node, its neighbours below it included, moves to the least of these
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").select("a", "b", "m")
        new = stored(small.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        before, mark = mark, digest(new)
        now = new
        if mark == before:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
