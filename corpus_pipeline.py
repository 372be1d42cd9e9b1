"""A training corpus from raw documents: quality, near duplicates, benchmark passages, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and judges all that the stage before it kept. All but the last return the columns of
``documents``. Documents that the quality classifier scores below 0.7 go; of each group of near duplicates (linked from a
similarity of 0.8 on) the one of the least id stays; documents with a benchmark passage go; secrets are replaced by a mark;
what is left is packed into sequences of 1024 tokens. SQL cannot express a classifier or a tokenizer, so ``ORACLE_SQL`` is None and the tests compare
the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, near_duplicates, packing, quality, secrets_scan
from strandlake.llm._spark import written

THRESHOLD, COPY_PERCENT = 0.7, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled rows of docs; null and empty texts are scored like others, rows that repeat an id each."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the least id stays; null and empty texts are linked with nothing; rows that share an id stay or go together."""
    return near_duplicates.without_copies(docs, percent=COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged each by itself; null and empty texts have no words and stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of every kind are replaced by a mark; n_chars follows. A text without one stays as it is, null too."""
    return secrets_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty and give their end mark; no rows give no rows."""
    return packing.pack(packing.cut(docs))


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
