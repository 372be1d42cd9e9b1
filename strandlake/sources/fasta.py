"""FASTA files.

A record begins with ``>`` at the start of a line: Spark's text reader splits files there, so large files are read in
parallel and records are cut and cleaned by native expressions. The name is the rest of its line; line breaks of the
sequence are removed and blanks inside it stay. A ``>`` anywhere else is a fault of its record. What stands before a file's
first record is a record without a sequence, and so a fault, unless it is blank or has several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import id_taxon
from strandlake.sources.modes import judged, known


def read_fasta(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """(name, sequence). mode: FAILFAST raises on a malformed record, DROPMALFORMED leaves it out, PERMISSIVE keeps it with the fault in ``_corrupt_record``."""
    known(mode)
    raw = spark.read.option("lineSep", "\n>").text(path)
    records = _records(raw).select(F.regexp_replace("value", r"^>", "").alias("value"))
    body = F.regexp_replace("value", r"^[^\r\n]*[\r\n]*", "")
    name = F.regexp_extract("value", r"^[^\r\n]*", 0)
    sequence = F.translate(body, "\r\n", "")
    has_line = F.col("value").rlike(r"[\r\n]")
    fault = F.when(~has_line & (F.trim("value") != ""), "no sequence follows the header, or the file does not start with '>'").when(F.trim(name) == "", "the header is empty").when(F.contains("value", F.lit(">")), "'>' stands inside a line").when(F.trim(sequence) == "", "the sequence is empty")
    if mode == "FAILFAST" and not _has_rows(raw):
        raise ValueError("No FASTA data found!")
    return judged(records, fault, [name.alias("name"), sequence.alias("sequence")], mode, "FASTA record")


_BLANK = r"^[ \t\r\n]*\z"


def _records(raw: DataFrame) -> DataFrame:
    """Without what stands before the first record of a file, where that is blank. A blank text anywhere else is a record without a name and bases.

    Where each file's text begins comes from a second reading of the same splits, one row a file.
    """
    placed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    firsts = placed.where("block = 0").groupBy("file").agg(F.min(F.struct("row", F.col("value").rlike(_BLANK).alias("blank"))).alias("first"))
    before = firsts.where("first.blank").select("file", F.col("first.row").alias("row"))
    return placed.join(F.broadcast(before), ["file", "row"], "left_anti").select("value")


def _has_rows(raw: DataFrame) -> bool:
    return not _records(raw).isEmpty()


def annotated(records: DataFrame) -> DataFrame:
    """(name, sequence, taxon) of records whose header has a taxon in braces; others have a null taxon."""
    found = id_taxon(F.col("name"))
    return records.select(F.coalesce(found["id"], F.col("name")).alias("name"), "sequence", found["taxon"].alias("taxon"))


def fasta_line(name: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), sequence)


def write_fasta(records: DataFrame, path: str, mode: str = "error") -> None:
    records.select(fasta_line(F.col("name"), F.col("sequence")).alias("value")).write.mode(mode).text(path)
