"""Costs that must follow the length, readers that split, and the operators that came with them."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions import sequence as sq
from strandlake.operators import alignment as al
from strandlake.operators import kmers as km
from strandlake.operators import sampling as sp
from strandlake.operators import trimming as tr
from strandlake.sources.fasta import read_fasta
from strandlake.sources.fastq import read_fastq
from strandlake.sources.sam import read_sam_header, reference_order


def bases(n, seed=1, letters="ACGT"):
    rnd = random.Random(seed)
    return "".join(rnd.choice(letters) for _ in range(n))


def test_kmers_of_long_sequences(spark):
    seq = bases(1000, letters="ACGTN")
    for k in (2, 17, 42):
        got = sorted((r["pos"], r["kmer"]) for r in km.kmers(spark.createDataFrame([(seq,), ("A",), (None,), ("",)], "s string"), "s", k).collect())
        assert got == [(i, seq[i : i + k]) for i in range(len(seq) - k + 1)]
    for n in (km.PIECE - 1, km.PIECE, km.PIECE + 1, 2 * km.PIECE + 3):
        assert km.kmers(spark.createDataFrame([(bases(n),)], "s string"), "s", 5).count() == n - 4


def test_cost_follows_the_length(spark):
    """Twice the length takes about twice the time: not four times, as where each window is cut from the sequence's start."""
    long = bases(1_200_000)
    frames = [spark.createDataFrame([(long[:n],)], "s string").coalesce(1).cache() for n in (600_000, 1_200_000)]
    for f in frames:
        f.count()
    s = F.col("s")
    works = (
        lambda f: km.kmer_counts(f, "s", 6).agg(F.sum("count")).first(),
        lambda f: f.select(F.size(sq.stepped_windows(s, 12, 5))).first(),
        lambda f: f.select(sq.find_fuzzy(s, "G" * 30, 2)).first(),
        lambda f: f.select(F.length(cg.aligned_pair(s, s, F.repeat(F.lit("1M1I1D"), (F.length(s) / 4).cast("int")), F.lit(0))["ref"])).first(),
    )
    for work in works:
        work(frames[0])
        took = []
        for f in frames:
            best = 1e9
            for _ in range(3):
                began = time.perf_counter()
                work(f)
                best = min(best, time.perf_counter() - began)
            took.append(best)
        assert took[1] < 3 * took[0] + 0.5


def test_wide_encoding(spark):
    for k, bits in ((2, 3), (21, 3), (22, 3), (42, 3), (31, 2), (32, 2), (33, 2), (64, 2)):
        letters = "NACGT" if bits == 3 else "ACGT"
        rows = [("T" * k,), ("A" * k,), *((bases(k, i, letters),) for i in range(5))]
        df = spark.createDataFrame(rows, "s string")
        s = F.col("s")
        wide = km.encode_wide(s, bits)
        got = df.select("s", wide.alias("w"), km.decode_wide(wide, k, bits).alias("back")).collect()
        codes = {"N": 3, "A": 4, "C": 5, "G": 6, "T": 7} if bits == 3 else {"A": 0, "C": 1, "G": 2, "T": 3}
        for r in got:
            number = 0
            for c in r["s"]:
                number = number << bits | codes[c]
            assert (r["w"]["high"] % (1 << 64)) << 64 | r["w"]["low"] % (1 << 64) == number
            assert r["back"] == r["s"]
        if k <= (21 if bits == 3 else 32):
            assert all(r[0] == r[1] for r in df.select("s", km.decode(km.encode(s, bits), k, bits)).collect())
        else:
            with pytest.raises(Exception, match="encode_wide"):
                df.select(km.encode(s, bits)).collect()


def test_fuzzy_and_windows(spark):
    rnd = random.Random(4)
    rows = [(i, bases(rnd.randint(0, 300), i)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, s string")
    for needle, k in (("ACGTACGTAC", 2), ("GAT", 0), ("GATTACA", 1), ("AC", 2)):
        got = dict(df.select("i", sq.find_fuzzy(F.col("s"), needle, k)["start"]).collect())
        for i, s in rows:
            places = [j for j in range(len(s) - len(needle) + 1) if sum(a != b for a, b in zip(s[j:], needle)) <= k]
            assert got[i] == (places[0] if places else None)
    for size, step in ((12, 5), (5, 12), (3, 3), (1, 1)):
        got = dict(df.select("i", sq.stepped_windows(F.col("s"), size, step)).collect())
        assert all(got[i] == [s[j : j + size] for j in range(0, len(s) - size + 1, step)] for i, s in rows)
    found = df.select("i", sq.position(F.col("s"), pattern="[GT]"), sq.last_position(F.col("s"), "C")).collect()
    for i, a, b in found:
        s = rows[i][1]
        assert a == next((j for j, c in enumerate(s) if c in "GT"), None)
        assert b == (s.rindex("C") if "C" in s else None)


def test_alignment_of_many_and_long_pairs():
    rnd = random.Random(9)
    w = al.Weights.dna(2, -3)
    pairs = [(bases(rnd.randint(0, 40), i), bases(rnd.randint(1, 40), 1000 + i)) for i in range(120)]
    coded = [(w.codes(a), w.codes(b)) for a, b in pairs]
    for mode in ("local", "global"):
        one = [al.align_pair(a, b, w, -5, -1, mode) for a, b in pairs]
        assert al.align_pairs(coded, w.array(), -5, -1, mode) == one
        # so few cells at a time that every matrix is filled again from kept rows
        assert al.align_pairs(coded, w.array(), -5, -1, mode, cells=1) == one
        assert [s for s, _, _ in al.score_pairs(coded, w.array(), -5, -1, mode)] == [x[1] or 0 for x in one]
    assert al.align_pairs(coded, w.array(), -5, -1, "local", 6, cells=1) == al.align_pairs(coded, w.array(), -5, -1, "local", 6)
    for (a, b), r in zip(coded, al.ranges_of(coded, w.array(), -5, -1), strict=True):
        whole, three = al.align_pairs([(a, b)], w.array(), -5, -1)[0], al.three_pass(a, b, w.array(), -5, -1)
        assert (r or (None,))[0] == whole[1] == three[1]
        if r is not None:
            assert three[1:6] == r
            assert al.rescore("".join("ACGTN"[c] for c in a), "".join("ACGTN"[c] for c in b), three[6], three[2], w, -5, -1) == r[0]
            # an alignment of that score lies within the ranges
            assert al.align_pairs([(a[r[1] : r[2]], b[r[3] : r[4]])], w.array(), -5, -1, "global")[0][1] == r[0]


def test_alignment_columns(spark):
    w = al.Weights.dna(4, -2)
    df = spark.createDataFrame([("GGCCACAGGATTGAG", "CTCAGATTG"), ("CCC", "AAA"), (None, "A"), ("A", None)], "r string, q string")
    r, q = F.col("r"), F.col("q")
    assert [tuple(x[0]) for x in df.select(al.score_ranges(r, q, w, -3, -1)).collect()][:2] == [(27, 3, 13, 0, 9), (None,) * 5]
    a = df.select("r", "q", al.align(r, q, w, -3, -1, strategy="three_pass").alias("a"))
    scored = a.select(al.path_score(F.col("r"), F.col("q"), F.col("a"), w, -3, -1).alias("p")).collect()
    assert tuple(scored[0]["p"]) == (27, None)
    bad = spark.createDataFrame([("ACGT", "ACGT", c) for c in ("5M", "3M", "2M9D2M", "4M1S", "x")], "r string, q string, c string")
    alignment = F.struct(F.col("c").alias("cigar"), F.lit(0).alias("ref_start"))
    assert [x[0] for x in bad.select(al.path_score(F.col("r"), F.col("q"), alignment, w, -3, -1)["error"]).collect()] == ["ReferenceEnded", "QueryLeft", "ReferenceEnded", "QueryEnded", "InvalidCigar"]
    over = a.where("r like 'GG%'").select(al.overflowing(F.col("a"), -128, 20).alias("a")).select("a.status", "a.score", al.status(F.col("a"), {"Overflowed": F.lit(1)}).alias("s")).first()
    assert tuple(over) == ("Overflowed", None, 1)


def test_matrix_forms():
    w = al.Weights.from_function("ABC", lambda a, b: ord(a) - ord(b))
    assert (w.get("A", "C"), w.get("C", "a")) == (-2, 2)
    assert w.subset("CA").table == ((0, 2), (-2, 0))
    shifted, bias = w.biased()
    assert bias == -2 and shifted.get("A", "C") == 0
    assert al.parse_matrix(w.text()).table == w.table
    with pytest.raises(ValueError):
        w.subset("AZ")


def test_trimming(spark):
    primer = "TGATAGTTTTAGAGTTAGGTAG"
    steps = [tr.runs("G", 5), tr.hard(2), tr.primer(tr.primer_kmers(primer, 17, 1), 30)]
    known = set(tr.primer_kmers(primer, 17, 1))

    def literal(s):
        a, b = 0, len(s)
        n = len(s) - len(s.lstrip("G"))
        a += n if n >= 5 else 0
        n = len(s[a:]) - len(s[a:].rstrip("G"))
        b -= n if n >= 5 else 0
        if b - a > 4:
            a, b = a + 2, b - 2
        head = s[a:b][:30]
        for i in range(len(head) - 17, -1, -1):
            if head[i : i + 17] in known:
                return a + i + 17, b
        return a, b

    rows = ["", "GGGGGGG", "GGGGG" + "ACGTTT", "ACGT", "GGGGACGTGGGGG", "CC" + primer + "ACGTACGTAA", "ACGTAC" + primer[:9] + "C" + primer[10:] + "TTTT", "A" * 20 + primer + "CC", "GGGGGG" + "CC" + primer + "TTGGGGGGG"]
    reads = spark.createDataFrame([(i, s, "".join(chr(33 + j % 90) for j in range(len(s))), "x") for i, s in enumerate(rows)], "i int, sequence string, quality string, cut string")
    for r in tr.trim(reads, steps).collect():
        a, b = literal(rows[r["i"]])
        assert (r["sequence"], r["quality"], r["cut"]) == (rows[r["i"]][a:b], "".join(chr(33 + j % 90) for j in range(len(rows[r["i"]])))[a:b], "x")


def test_large_reservoir(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("k"))
    small = {r[0] for r in sp.reservoir(df, "k", 700).collect()}
    monkeypatch.setattr(sp, "SORTED", 0)
    for n in (700, 5000, 6000):
        got = [r[0] for r in sp.reservoir(df, "k", n).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)
        assert n != 700 or set(got) == small


def test_fasta_with_a_stray_mark(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a\nAC>GT\nTTT\n>b>c\nA\n>d\nCC\n>\nG\n")
    got = {r["name"]: r["_corrupt_record"] for r in read_fasta(spark, str(tmp_path / "a.fasta"), "PERMISSIVE").collect()}
    assert got["d"] is None and all(got[x] for x in ("a", "b>c", ""))
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fasta"), "DROPMALFORMED").collect()] == [("d", "CC")]
    with pytest.raises(Exception, match="stands inside"):
        read_fasta(spark, str(tmp_path / "a.fasta")).collect()


GOOD = "@r\nACGT\n+\nIIII\n"
FAULTS = {
    "": "No FASTQ data", "r\nACGT\n+\nIIII\n": "start with '@'", "@\nACGT\n+\nIIII\n": "missing FASTQ header", "@r\n\n+\nIIII\n": "missing FASTQ sequence",
    "@r\nACGT\nIIII\n@": "missing '\\+' line", "@r\nACGT\n+\n": "missing FASTQ quality", "@r\nACGT\n+\nIII\n": "length mismatch", "@r\nACGT\n+\nI I\x7f\n": "graphic ASCII",
}


@pytest.mark.parametrize("text", list(FAULTS))
@pytest.mark.parametrize("second", [False, True])
def test_fastq_faults(spark, tmp_path, text, second):
    if second and not text:
        return
    (tmp_path / "a.fastq").write_text(GOOD * second + text)
    path = str(tmp_path / "a.fastq")
    with pytest.raises(Exception, match=FAULTS[text]):
        read_fastq(spark, path).collect()
    assert read_fastq(spark, path, "DROPMALFORMED").count() == int(second)
    if text:
        assert [r["_corrupt_record"] is None for r in read_fastq(spark, path, "PERMISSIVE").collect()].count(True) == int(second)


def test_fastq_splits(spark, tmp_path):
    """Every record is read once wherever splits begin, among qualities that look like headers."""
    rnd = random.Random(3)
    records = []
    for i in range(300):
        n = rnd.randint(1, 60)
        records.append((f"r{i} é", bases(n, i), "@" + "".join(rnd.choice("@+!~IA") for _ in range(n - 1))))
    text = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{q}\n" for i, (h, s, q) in enumerate(records))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    for split in (37, 1000, 1 << 20):
        assert sorted(map(tuple, read_fastq(spark, str(tmp_path / "a.fastq"), split_bytes=split).collect())) == sorted(records)
    for schemes in (("file",), ("s3",)):  # opened by the tasks, or loaded by Spark
        assert sorted(map(tuple, read_fastq(spark, str(tmp_path / "b.fastq.gz"), split_bytes=37, schemes=schemes).collect())) == sorted(records)
    assert read_fastq(spark, str(tmp_path / "a.fastq"), schemes=("s3",)).count() == 300


def test_sam_header_order(spark, tmp_path):
    names = [f"chr{(i * 7919) % 5000}" for i in range(5000)]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:5\n" for n in names) + "r\t0\tchr1\t1\t60\t1M\t*\t0\t0\tA\tI\n")
    order = reference_order(read_sam_header(spark, str(tmp_path / "a.sam")))
    assert [r["rname"] for r in order.orderBy("idx").collect()] == names
