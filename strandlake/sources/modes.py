"""What readers do with malformed records.

FAILFAST raises, DROPMALFORMED leaves them out, PERMISSIVE keeps them with the fault in ``_corrupt_record``. In FAILFAST the
check is a filter over whole rows: a projection that reads none of a record's columns, or ``count()``, keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.sources.scratch import scratch

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
CORRUPT = "_corrupt_record"


def known(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"no mode is called {mode}; there are {', '.join(MODES)}")
    return mode


def judged(rows: DataFrame, fault: Column, columns: list[Column], mode: str, what: str) -> DataFrame:
    """The columns of the rows, by the mode. fault: a message for each malformed row, else null."""
    if mode == "PERMISSIVE":
        return rows.select(*columns, fault.alias(CORRUPT))
    if mode == "DROPMALFORMED":
        return rows.where(fault.isNull()).select(*columns)
    fails = F.raise_error(F.concat(F.lit(f"malformed {what}: "), fault)).cast("boolean")
    return rows.where(F.when(fault.isNull(), F.lit(True)).otherwise(fails)).select(*columns)


def separated(records: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The good records, the malformed ones, and how many there are of each, of a frame read with PERMISSIVE.

    Files are read once: both sides are written to one table under ``path`` (by default a new folder in spark.checkpoint.dir),
    apart by folder, while an observation counts them.
    """
    spark = records.sparkSession
    path = path or scratch(spark)
    bad = F.col(CORRUPT).isNotNull()
    counts = Observation()
    (side,) = [n for n in ("malformed", "malformed_", "malformed__") if n not in {c.lower() for c in records.columns}][:1]
    records.observe(counts, F.count(F.when(~bad, 1)).alias("good"), F.count(F.when(bad, 1)).alias("malformed")).withColumn(side, bad).write.partitionBy(side).parquet(path)
    back = spark.read.schema(records.withColumn(side, bad).schema).parquet(path)
    return back.where(~F.col(side)).drop(side, CORRUPT), back.where(F.col(side)).drop(side), counts.get


def results(records: DataFrame) -> DataFrame:
    """The good records of a frame read with PERMISSIVE; the first malformed one that a task meets ends the job with its fault."""
    return judged(records, F.col(CORRUPT), [F.col(c) for c in records.columns if c != CORRUPT], "FAILFAST", "record")
