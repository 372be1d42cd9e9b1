"""FASTQ files.

Records are four strict lines and are not self-delimiting, as a quality line may start with ``@``. A plain file is read in
splits. Where a split begins is moved on to the next boundary, a place that every reader of the file from its start comes
to, whatever faults lie before: a line from which four lines make a record, the second of which starts with neither ``@`` nor
``+``, and which isn't the last line of a record itself. Each split reads from its boundary to the next split's, so a malformed
record belongs to the split in which reading the whole file would meet it. A gzip file is one task. Lines are streamed, so memory is bounded by a batch of
records whatever a file's size. Files are opened by Arrow's file systems; where these do not know a path's scheme, Spark
itself loads the file, up to the 2 GB that it can hold in a row.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.shipping import ship
from strandlake.sources.modes import known

SCHEMA = "header string, sequence string, quality string"
BATCH = 4096
SPLIT_BYTES = 64 << 20
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def fault(header: str, sequence: str, plus: str, quality: str) -> str | None:
    """What is wrong with the four lines of a record."""
    if not header.startswith("@"):
        return f"a FASTQ header must start with '@': {header[:50]!r}" if header else "missing FASTQ header"
    if len(header) == 1:
        return "missing FASTQ header"
    if not sequence:
        return f"missing FASTQ sequence: {header}"
    if not plus.startswith("+"):
        return f"missing '+' line: {header}"
    if not quality:
        return f"missing FASTQ quality scores: {header}"
    if len(quality) != len(sequence):
        return f"sequence and quality score length mismatch ({len(sequence)} and {len(quality)}): {header}"
    if not quality.isascii() or not quality.isprintable() or " " in quality:
        return f"the quality scores are not graphic ASCII: {header}"
    return None


def begins(lines: list[str]) -> bool:
    """Whether a record starts at the first of these lines, with or without a fault in its letters or scores."""
    return len(lines) >= 4 and lines[0].startswith("@") and lines[2].startswith("+")


def entries(lines: Iterator[tuple[int, str]], end: int | None = None) -> Iterator[tuple[str, str, str, str | None]]:
    """(header, sequence, quality, fault) of the records that begin before ``end``, a boundary or none. lines: each with its place in the file.

    After a malformed record reading goes on where the next one begins.
    """
    held: list[tuple[int, str]] = []
    lines = iter(lines)

    def filled(n: int) -> bool:
        while len(held) < n and (x := next(lines, None)) is not None:
            held.append(x)
        return len(held) >= n

    while filled(1) and (end is None or held[0][0] < end):
        filled(4)
        texts = [x for _, x in held[:4]] + [""] * (4 - len(held[:4]))
        wrong = fault(*texts)
        if wrong is None:
            yield texts[0][1:], texts[1], texts[3], None
            del held[:4]
            continue
        yield texts[0].removeprefix("@"), texts[1], texts[3], wrong
        del held[:1]
        while filled(1) and not (filled(4) and begins([x for _, x in held[:4]])):
            del held[:1]


def parse(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """Records of lines without line ends; a ValueError says what is wrong."""
    for header, sequence, quality, wrong in entries((0, x) for x in lines):
        if wrong:
            raise ValueError(wrong)
        yield header, sequence, quality


def _lines(stream: io.BufferedIOBase, at: int = 0) -> Iterator[tuple[int, str]]:
    for line in stream:
        yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
        at += len(line)


def _opened(path: str, start: int):
    """The lines of a file from the first that begins at ``start`` or later, each with its place."""
    from urllib.parse import unquote

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + unquote(path.removeprefix("file:")))
    if path.endswith(".gz"):
        return _lines(gzip.GzipFile(fileobj=system.open_input_stream(name, compression=None)))
    stream = io.BufferedReader(system.open_input_file(name), 1 << 20)
    if start:
        stream.seek(start - 1)
        start += len(stream.readline()) - 1
    return _lines(stream, start)


def boundary(lines: Iterator[tuple[int, str]]) -> int | None:
    """The first place among these lines, from the fourth on, at which a reader of the whole file begins a record; None if there is none.

    Such a reader steps over a whole record or on to the next line that begins one. It can't step over a line that begins one
    unless that is the second, third or last line of a record: the line after it, or the three before it, tell.
    """
    held: list[tuple[int, str]] = []
    for x in lines:
        held.append(x)
        if len(held) == 7:
            texts = [t for _, t in held]
            if begins(texts[3:]) and len(texts[3]) > 1 and texts[4][:1] not in ("", "@", "+") and fault(*texts[:4]) is not None:
                return held[3][0]
            del held[:1]
    return None


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """(header, sequence, quality) of files, plain or gzip. An empty file raises in FAILFAST.

    mode: FAILFAST raises on a malformed record, DROPMALFORMED leaves it out, PERMISSIVE keeps it with the fault in
    ``_corrupt_record``. schemes: of the paths that tasks open through Arrow (on a cluster whose executors have no HDFS
    library for it, leave hdfs out).
    """
    known(mode)
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    opened = F.col("path").rlike(rf"^({'|'.join(schemes)}):/")
    whole = F.endswith("path", F.lit(".gz")) | ~opened
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    splits = files.where(opened).select("path", "length", F.explode(starts).alias("start"), whole.alias("whole"), F.lit(None).cast("binary").alias("content"))
    n = splits.count()
    splits = splits.repartition(max(n, 1), "path", "start")
    others = files.where(~opened).select("path", "length", F.lit(0).cast("bigint").alias("start"), F.lit(True).alias("whole"), "content")
    schema = SCHEMA + ", _corrupt_record string" * (mode == "PERMISSIVE")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, start, entire, content in zip(*(batch[c].to_pylist() for c in ("path", "length", "start", "whole")), batch["content"], strict=True):
                end = None if entire or start + split_bytes >= length else start + split_bytes
                if content.is_valid:
                    stream = io.BytesIO(content.as_buffer())
                    lines = _lines(gzip.GzipFile(fileobj=stream) if file.endswith(".gz") else stream)
                else:
                    if start:
                        if (first := boundary(_opened(file, start))) is None:
                            continue
                        lines = _opened(file, first)
                    else:
                        lines = _opened(file, 0)
                    end = end and boundary(_opened(file, end))
                    if start and end == first:
                        continue
                rows: list[tuple] = []
                some = False
                for record in entries(lines, end):
                    some = True
                    if record[3] and mode != "PERMISSIVE":
                        if mode == "FAILFAST":
                            raise ValueError(record[3])
                        continue
                    rows.append(record if mode == "PERMISSIVE" else record[:3])
                    if len(rows) == BATCH:
                        yield _batch(rows, schema)
                        rows = []
                if not some and not start and mode == "FAILFAST":
                    raise ValueError("No FASTQ data found!")
                if rows:
                    yield _batch(rows, schema)

    out = splits.mapInArrow(run, schema)
    if others.select("path").isEmpty():
        if not n and mode == "FAILFAST":  # Spark lists no files without bytes
            raise ValueError("No FASTQ data found!")
        return out
    return out.unionByName(others.mapInArrow(run, schema))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def reverse_complement(records: DataFrame) -> DataFrame:
    """Both the sequence and its quality turned."""
    from strandlake.functions.sequence import reverse_complement as turned

    return records.withColumn("sequence", turned(F.col("sequence"))).withColumn("quality", F.reverse("quality"))


def fastq_line(header: Column, sequence: Column, quality: Column) -> Column:
    return F.concat(F.lit("@"), header, F.lit("\n"), sequence, F.lit("\n+\n"), quality)


def write_fastq(records: DataFrame, path: str, mode: str = "error") -> None:
    records.select(fastq_line(F.col("header"), F.col("sequence"), F.col("quality")).alias("value")).write.mode(mode).text(path)
