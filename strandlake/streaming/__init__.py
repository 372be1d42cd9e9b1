"""The same operators over streams: sources of lines, and tallies that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.composition import merged_counts
from strandlake.operators.kmers import kmer_counts
from strandlake.sources.sam import records_of


def sam_stream(spark: SparkSession, path: str) -> DataFrame:
    """SAM records of files as they arrive."""
    return records_of(spark.readStream.text(path))


def kmer_count_stream(stream: DataFrame, seq: str, k: int, *, bits: int = 3) -> DataFrame:
    """Running (kmer, count), for update or complete mode."""
    return kmer_counts(stream, seq, k, bits=bits)


def windowed_base_counts(stream: DataFrame, seq: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Base counts for each window of event time, final once the watermark has passed it."""
    marked = stream.withWatermark(time, late).withColumn("window", F.window(time, window))
    return merged_counts(marked, seq, "window")
