"""SAM files: a row a line, split and cast by native expressions, so that files are read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.sam import FIELDS, HEADER
from strandlake.sources.modes import judged, known


def records_of(lines: DataFrame, value: str = "value", mode: str = "FAILFAST", optional: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alignment rows of a frame of lines (batch or streaming). Mate columns are not kept: rnext is ``*``, pnext and tlen 0.

    mode: FAILFAST raises on a malformed row, DROPMALFORMED leaves it out, PERMISSIVE keeps what of it can be read with the fault in ``_corrupt_record``.
    """
    known(mode)
    data = lines.where(~F.startswith(value, F.lit("@")) & (F.col(value) != ""))
    p = F.split(F.regexp_replace(value, r"\r\z", ""), "\t", -1)
    raw = data.select(p.alias("p"), *keep)
    c = F.col("p")
    bare = lambda x: F.when(x == "*", "").otherwise(x)
    at = lambda i: F.get(c, F.lit(i))
    wrong = lambda good, what: F.when(~F.coalesce(good, F.lit(False)), what)
    fault = F.coalesce(
        wrong(F.size(c) >= 11, "fewer than 11 fields"),
        wrong(at(1).try_cast("int").between(0, 65535), "the flag is no number of 16 bits"),
        wrong(at(3).try_cast("bigint") >= 0, "the position is no number from 0 on"),
        wrong(at(4).try_cast("int").between(0, 255), "the mapping quality is no number of 8 bits"),
        wrong(at(10).rlike(r"^[!-~]*\z"), "the quality scores are not graphic ASCII"),
    )
    columns = [at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("rname"), at(3).try_cast("bigint").alias("pos"), at(4).try_cast("smallint").alias("mapq"), bare(F.trim(at(5))).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).cast("bigint").alias("pnext"), F.lit(0).alias("tlen"), at(9).alias("seq"), bare(at(10)).alias("qual")]
    if optional:
        columns.append(F.slice(c, F.lit(12), F.greatest(F.size(c) - 11, F.lit(0))).alias("opt_fields"))
    return judged(raw, fault, [*columns, *map(F.col, keep)], mode, "SAM row")


def read_sam(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", optional: bool = True, ordinal: str | None = None) -> DataFrame:
    """The rows of files. ordinal: a further column of this name that orders rows by file and by their place in it.

    It holds the file, the start of the part of the file that a task has read, and the row's number in the task.
    """
    lines = spark.read.text(path)
    if ordinal is None:
        return records_of(lines, mode=mode, optional=optional)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return records_of(lines.select("value", place.alias(ordinal)), mode=mode, optional=optional, keep=(ordinal,))


def read_sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, idx) of the header in its order, from the start of the first file (by name)."""
    first = min(spark.read.text(path).inputFiles())
    lines, n = spark.sparkContext.textFile(first), 1024
    while True:  # ``take`` reads a file's first split first
        head = lines.take(n)
        size = next((i for i, x in enumerate(head) if not x.startswith("@")), len(head))
        if size < len(head) or len(head) < n:
            return spark.createDataFrame([(x.rstrip("\r"), i) for i, x in enumerate(head[:size])], "line string, idx int")
        n *= 4


def reference_order(header: DataFrame) -> DataFrame:
    """(rname, idx) of a header's @SQ lines in their order."""
    name = F.regexp_extract("line", r"\tSN:([^\t]+)", 1)
    return header.where(F.startswith("line", F.lit("@SQ"))).select(name.alias("rname"), "idx")


def sam_line(record: dict[str, Column]) -> Column:
    """The text of a record; empty fields print as ``*``."""
    star = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "*").otherwise(x)
    fields = [star(record[f]) if f in ("cigar", "seq", "qual") else record[f].cast("string") for f in FIELDS]
    line = F.concat_ws("\t", *fields)
    return F.concat_ws("\t", line, record["opt_fields"]) if "opt_fields" in record else line


def write_sam(records: DataFrame, path: str, header: DataFrame | None = None, mode: str = "error") -> None:
    """Lines of text; a header frame (line) is written to a folder beside the records' parts as its first file."""
    line = sam_line({c: F.col(c) for c in records.columns}).alias("value")
    body = records.select(line)
    if header is not None:
        head = header.orderBy("idx") if "idx" in header.columns else header
        body = head.select(F.col("line").alias("value")).coalesce(1).unionByName(body)
    body.write.mode(mode).text(path)


def sorted_header(header: DataFrame) -> DataFrame:
    """The header (line, idx) of a coordinate-sorted file: the @HD line first."""
    first = header.sparkSession.createDataFrame([(HEADER, -1)], "line string, idx int")
    return first.unionByName(header.where(~F.startswith("line", F.lit("@HD"))).select("line", "idx"))
