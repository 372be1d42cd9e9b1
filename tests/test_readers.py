"""Malformed records, wherever a file is split and whatever columns are read."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import fastq
from strandlake.sources.fasta import read_fasta
from strandlake.sources.fastq import read_fastq
from strandlake.sources.modes import results, separated
from strandlake.sources.sam import read_sam

#: Records with a fault each; the last ones make lines that look like the start of a record.
FAULTS = {
    "short quality": "@bad\nACGT\n+\nIII\n",
    "no at sign": "bad\nACGT\n+\nIIII\n",
    "empty header": "@\nACGT\n+\nIIII\n",
    "no plus": "@bad\nACGT\nIIII\n",
    "no sequence": "@bad\n\n+\n\n",
    "blank in quality": "@bad\nACGT\n+\nI II\n",
    "lost header": "ACGT\n+\nIIII\n",
    "quality as header": "ACGT\n+bad\n@III\n@III\n",
    "lost line": "@bad\n+\nIIII\n",
}


def records(rnd, n):
    out = []
    for i in range(n):
        size = rnd.randint(1, 12)
        out.append(f"@r{i}\n{''.join(rnd.choice('ACGTN') for _ in range(size))}\n+{rnd.choice(['', f'r{i}', '@'])}\n{''.join(rnd.choice('@+I#') for _ in range(size))}\n")
    return out


def serial(text):
    return list(fastq.entries((0, x) for x in text.encode().decode("utf-8").splitlines()))


def in_splits(path, size, step):
    """What tasks read of a local file that is cut at every ``step`` bytes."""
    out = []
    for start in range(0, size, step):
        end = start + step if start + step < size else None
        first = fastq.boundary(fastq._opened(path, start)) if start else 0
        if first is None:
            continue
        stop = end and fastq.boundary(fastq._opened(path, end))
        if not (start and stop == first):
            out += fastq.entries(fastq._opened(path, first), stop)
    return out


@pytest.mark.parametrize("what", FAULTS)
def test_every_split_meets_each_fault_once(tmp_path, what):
    rnd = random.Random(what)
    for k in (0, 3, 11, 12):
        good = records(rnd, 12)
        text = "".join([*good[:k], FAULTS[what], *good[k:]])
        path = tmp_path / f"{k}.fastq"
        path.write_bytes(text.encode())
        expected = serial(text)
        assert any(r[3] for r in expected)
        for step in range(1, len(text) + 2):
            assert in_splits(str(path), len(text), step) == expected, (what, k, step)


def test_random_faults_and_splits(tmp_path):
    rnd = random.Random(5)
    for i in range(40):
        parts = [rnd.choice(list(FAULTS.values())) if rnd.random() < 0.3 else r for r in records(rnd, 15)]
        text = "".join(parts)
        if rnd.random() < 0.3:
            text = text.rstrip("\n")
        path = tmp_path / f"{i}.fastq"
        path.write_bytes(text.encode())
        for step in {rnd.randint(1, len(text)) for _ in range(12)}:
            assert in_splits(str(path), len(text), step) == serial(text)


def test_fastq_modes(spark, tmp_path):
    text = "".join(records(random.Random(1), 12))
    at = text.index("@r7\n")
    text = text[:at] + FAULTS["short quality"] + text[at:]
    path = tmp_path / "a.fastq"
    path.write_bytes(text.encode())
    for split in (at - 3, at, at + 5, 17, 1 << 20):
        with pytest.raises(Exception, match="length mismatch"):
            read_fastq(spark, str(path), split_bytes=split).select("header").count()
        assert read_fastq(spark, str(path), "DROPMALFORMED", split_bytes=split).count() == 12
        kept = read_fastq(spark, str(path), "PERMISSIVE", split_bytes=split)
        assert kept.count() == 13 and kept.where("_corrupt_record is not null").count() == 1
    for name in ("x", "permissive", ""):
        with pytest.raises(ValueError):
            read_fastq(spark, str(path), name)


SAM = ["@HD\tVN:1.6", "r1\t0\tchr\t5\t60\t3M\t*\t0\t0\tACG\tIII\tAS:i:3", "r2\tx\tchr\t5\t60\t3M\t*\t0\t0\tACG\tIII", "r3\t0\tchr\tNOTANUMBER\t60\t3M\t*\t0\t0\tACG\tIII", "r4\t0\tchr\t5\t256\t3M\t*\t0\t0\tACG\tIII", "r5\t0\tchr\t5\t60\t3M\t*\t0\t0\tACG", "r6\t0\tchr\t5\t60\t3M\t*\t0\t0\tACG\tI I", "r7\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\r"]


def test_sam_modes(spark, tmp_path):
    for i, bad in enumerate(SAM[2:7]):
        (tmp_path / f"{i}.sam").write_text("\n".join([*SAM[:2], bad, SAM[7]]) + "\n")
        one = read_sam(spark, str(tmp_path / f"{i}.sam"))
        for work in (one.count, *(one.select(c).collect for c in one.columns), one.where("pos > 100").collect, one.groupBy().agg(F.max("mapq")).collect):
            with pytest.raises(Exception, match="malformed SAM row"):
                work()
    (tmp_path / "all.sam").write_text("\n".join(SAM) + "\n")
    path = str(tmp_path / "all.sam")
    assert [r["qname"] for r in read_sam(spark, path, "DROPMALFORMED").collect()] == ["r1", "r7"]
    kept = read_sam(spark, path, "PERMISSIVE").collect()
    assert [r["qname"] for r in kept] == [f"r{i}" for i in range(1, 8)]
    assert [r["_corrupt_record"] is None for r in kept] == [True] + [False] * 5 + [True]
    assert kept[2]["pos"] is None and kept[2]["flag"] == 0 and kept[4]["qual"] is None
    with pytest.raises(ValueError):
        read_sam(spark, path, "LENIENT")
    (tmp_path / "empty.sam").write_text("")
    assert read_sam(spark, str(tmp_path / "empty.sam")).count() == 0


def test_fasta_modes(spark, tmp_path):
    for i, text in enumerate((">a\nAC\n>b\n>c\nGT\n", ">a\nAC\n>\nAC\n", "AC\n>a\nGT\n", ">a\nA>C\n>b\nC\n")):
        (tmp_path / f"{i}.fa").write_text(text)
        bad = read_fasta(spark, str(tmp_path / f"{i}.fa"))
        for work in (bad.count, bad.select("name").collect, bad.select("sequence").collect, bad.select(F.lit(1)).collect):
            with pytest.raises(Exception, match="malformed FASTA record"):
                work()
        kept = read_fasta(spark, str(tmp_path / f"{i}.fa"), "PERMISSIVE")
        assert kept.where("_corrupt_record is not null").count() == 1
        assert read_fasta(spark, str(tmp_path / f"{i}.fa"), "DROPMALFORMED").count() == kept.count() - 1


def test_both_sides_in_one_pass(spark, tmp_path):
    (tmp_path / "all.sam").write_text("\n".join(SAM) + "\n")
    rows = read_sam(spark, str(tmp_path / "all.sam"), "PERMISSIVE")
    good, bad, counts = separated(rows.withColumn("malformed", F.lit("a column of the caller's")))
    assert counts == {"good": 2, "malformed": 5} and good.count() == 2 and bad.count() == 5
    assert good.columns == [*rows.columns[:-1], "malformed"] and bad.where("_corrupt_record is null").count() == 0
    with pytest.raises(Exception, match="malformed record"):
        results(rows).count()
    assert results(rows.where("_corrupt_record is null")).count() == 2
    good, bad, counts = separated(rows.limit(0))
    assert counts == {"good": 0, "malformed": 0} and good.count() == bad.count() == 0


def test_a_blank_fasta_record_is_no_file_head(spark, tmp_path):
    """A record without a name and bases is malformed wherever it stands; only blank text before a file's first record is none."""
    texts = {"a.fa": "\n\n>r1\nAC\n>\n\n>r2\nGT\n>\n\n", "b.fa": ">\n\n>r3\nA\n", "c.fa": " \n>r4\nC\n>\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = [(r["name"], r["sequence"], r["_corrupt_record"]) for r in read_fasta(spark, str(tmp_path), "PERMISSIVE").collect()]
    assert sorted((n, s) for n, s, f in got if f is None) == [("r1", "AC"), ("r2", "GT"), ("r3", "A"), ("r4", "C")]
    assert [f for _, _, f in got if f] == ["the header is empty"] * 4
    assert read_fasta(spark, str(tmp_path), "DROPMALFORMED").count() == 4


def test_neighbouring_short_qualities(tmp_path):
    """Each record of a length mismatch is met, also behind another malformed one, wherever the file is cut."""
    rnd = random.Random(6)
    good = records(rnd, 8)
    bad = [f"@bad{i}\nACGTN\n+\n{'I' * (i % 5)}@\n" if i % 5 != 4 else f"@bad{i}\nACGTN\n+\nI III\n" for i in range(7)]
    text = "".join([*good[:4], *bad, *good[4:]])
    expected = serial(text)
    assert [r[0] for r in expected] == [*[f"r{i}" for i in range(4)], *[f"bad{i}" for i in range(7)], *[f"r{i}" for i in range(4, 8)]]
    assert sum(r[3] is not None for r in expected) == 7
    path = tmp_path / "a.fastq"
    path.write_bytes(text.encode())
    for step in range(1, len(text) + 2):
        assert in_splits(str(path), len(text), step) == expected, step
