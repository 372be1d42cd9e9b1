"""The formats, batch and stream, against the readers and against what was written."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import formats
from strandlake.sources.fasta import read_fasta
from strandlake.sources.fastq import read_fastq
from strandlake.sources.sam import read_sam
from tests.test_readers import FAULTS, SAM, records


@pytest.fixture(scope="module")
def formed(spark):
    formats.register(spark)
    return spark


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_same_as_the_readers(formed, tmp_path):
    rnd = random.Random(1)
    parts = [FAULTS["short quality"] if i % 9 == 4 else r for i, r in enumerate(records(rnd, 40))]
    (tmp_path / "a.fastq").write_text("".join(parts))
    (tmp_path / "b.fa").write_text("\n\n>a\nAC\nGT\n>b\n>c\nG T\n>\nAC\n>d>\nA\n" + "".join(f">r{i}\n{'ACGT' * (i % 5)}\n" for i in range(30)))
    (tmp_path / "c.sam").write_text("\n".join(SAM) + "\n")
    for kind, name, read in (("fastq", "a.fastq", read_fastq), ("fasta", "b.fa", read_fasta), ("sam", "c.sam", read_sam)):
        path = str(tmp_path / name)
        for size in (7, 50, 1 << 20):
            for mode in ("PERMISSIVE", "DROPMALFORMED"):
                got = formed.read.format(kind).option("splitBytes", size).option("mode", mode).load(path)
                expected = read(formed, path, mode)
                columns = [c for c in expected.columns if c != "_corrupt_record"]
                if mode == "PERMISSIVE":
                    columns.append(F.col("_corrupt_record").isNotNull())
                if kind == "sam":  # the fields behind a fault may be read or not
                    columns = ["qname", "rname", "cigar"] if mode == "PERMISSIVE" else columns
                assert rows(got.select(*columns)) == rows(expected.select(*columns)), (kind, size, mode)
        with pytest.raises(Exception, match="malformed"):
            formed.read.format(kind).load(path).count()


def test_tests_are_pushed(formed, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(records(random.Random(2), 30)))
    df = formed.read.format("fastq").load(str(tmp_path / "a.fastq"))
    assert df.where("header = 'r7'").count() == 1
    assert df.where("header in ('r7', 'r9', 'x')").count() == 2
    assert df.where("header like 'r1%' and length(sequence) > 0").count() == 11
    assert df.where("header > 'r5'").count() == sum(f"r{i}" > "r5" for i in range(30))


def test_written_and_read_back(formed, tmp_path):
    df = formed.range(100).select(F.concat(F.lit("r"), "id").alias("header"), F.repeat(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int")).alias("sequence")).withColumn("quality", F.translate("sequence", "ACGT", "@+I#")).repartition(3)
    path = str(tmp_path / "out")
    df.write.format("fastq").mode("append").save(path)
    assert rows(formed.read.format("fastq").load(path)) == rows(df)
    df.where("header < 'r5'").write.format("fastq").mode("append").save(path)
    assert formed.read.format("fastq").load(path).count() == 100 + df.where("header < 'r5'").count()
    df.limit(7).write.format("fastq").mode("overwrite").save(path)
    assert formed.read.format("fastq").load(path).count() == 7
    bad = df.withColumn("quality", F.when(F.col("header") == "r50", F.raise_error("stop").cast("string")).otherwise(F.col("quality")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("fastq").mode("append").save(path)
    assert formed.read.format("fastq").load(path).count() == 7 and not list((tmp_path / "out" / "_temporary").glob("*"))
    sam = formed.createDataFrame([("q", 0, "r", 5, 60, "2M", "*", 0, 0, "AC", "", ["AS:i:2"])], formats.FORMATS["sam"][0])
    sam.write.format("sam").mode("append").save(str(tmp_path / "sam"))
    assert rows(formed.read.format("sam").load(str(tmp_path / "sam"))) == rows(sam)
    fasta = formed.createDataFrame([("a", "ACGT"), ("b c", "NN")], formats.FORMATS["fasta"][0])
    fasta.write.format("fasta").mode("append").save(str(tmp_path / "fa"))
    assert rows(formed.read.format("fasta").load(str(tmp_path / "fa"))) == rows(fasta)


def test_streams_restart_once(formed, tmp_path):
    """Files that come before, between and after runs of a stopped query arrive once, through a stream of the format on both sides."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rnd = random.Random(3)
    expected = []

    def arrive(name):
        made = [r.replace("@r", f"@{name}r") for r in records(rnd, 25)]
        expected.extend(r.split("\n")[0][1:] for r in made)
        (source / f".{name}").write_text("".join(made))
        (source / f".{name}").rename(source / name)

    def run(fail=False):
        stream = formed.readStream.format("fastq").option("log", str(tmp_path / "log")).option("splitBytes", 200).load(str(source))
        if fail:
            stream = stream.withColumn("sequence", F.raise_error("stopped").cast("string"))
        q = stream.writeStream.format("fastq").option("checkpointLocation", str(tmp_path / "state")).start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    arrive("b")
    run()
    arrive("a")
    arrive("c")
    with pytest.raises(Exception, match="stopped"):
        run(fail=True)
    arrive("d")
    run()
    run()
    got = [r["header"] for r in formed.read.format("fastq").load(out).collect()]
    assert sorted(got) == sorted(expected) and len(set(got)) == 100
    # a commit that was cut off before its mark is done again, one behind its mark is not
    writer = formats.StreamWriter("fastq", {"path": out})
    again = [writer.write(iter([{"header": "x", "sequence": "A", "quality": "I"}]))]
    writer.commit(again, 0)
    assert formed.read.format("fastq").load(out).count() == 100
    with pytest.raises(Exception, match="log"):
        formed.readStream.format("fastq").load(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "s2")).start().processAllAvailable()
