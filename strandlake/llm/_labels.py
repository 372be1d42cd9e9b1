"""Bounded samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._text import quoted


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(quoted(doc_id)).cast("string").cast("binary")) % parts


def first_by_hash(rows: DataFrame, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the id, so always the same ones."""
    return rows.orderBy(F.xxhash64(F.col(quoted(doc_id)), F.lit(17)), quoted(doc_id)).limit(limit)


def labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, y) of the rows with a label of 0 or 1, one for each id: labels that repeat an id count as the greatest."""
    rows = labels.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("y"))
    return rows.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def one_a_document(rows: DataFrame, *values: str) -> DataFrame:
    """One row for each doc_id of (doc_id, tag, values): that of the least tag, by an aggregation with map-side combine."""
    first = rows.groupBy("doc_id").agg(F.min(F.struct("tag", *values)).alias("first"))
    return first.select("doc_id", *[F.col("first")[v].alias(v) for v in values])
