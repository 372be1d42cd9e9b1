"""Operators against literal versions, sources and streams."""

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from strandlake.operators import alignment as al
from strandlake.operators import composition as oc
from strandlake.operators import kmers as km
from strandlake.operators import sam as sm
from strandlake.operators import sampling as sp
from strandlake.sources.fasta import annotated, read_fasta, write_fasta
from strandlake.sources.fastq import parse, read_fastq, reverse_complement, write_fastq
from strandlake.sources.sam import read_sam, read_sam_header, reference_order, write_sam
from strandlake.streaming import kmer_count_stream, sam_stream


def frame(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, s string")


def test_kmers(spark):
    counts = {r["kmer"]: r["count"] for r in km.kmer_counts(frame(spark, "GGCCACCAAGGCCA", "AC", ""), "s", 3).collect()}
    assert counts == {"CCA": 3, "GCC": 2, "GGC": 2, "AAG": 1, "ACC": 1, "AGG": 1, "CAA": 1, "CAC": 1}
    assert frame(spark, "acgu-").select(km.windows(F.col("s"), 3).alias("w")).first()["w"] == ["ACG", "CGT", "GTN"]
    with pytest.raises(ValueError):
        km.check_length(1)


def test_variants_and_codes(spark):
    for n in (1, 2):
        got = spark.createDataFrame([("ACG",)], "k string").select(km.variants(F.col("k"), 3, n).alias("v")).first()["v"]
        expected = {"".join(x) for x in product("NACGT", repeat=3) if sum(a != b for a, b in zip(x, "ACG", strict=True)) <= n}
        assert len(got) == len(expected) and set(got) == expected
    row = spark.createDataFrame([("NACGT",)], "k string").select(km.encode(F.col("k")).alias("c")).withColumn("d", km.decode(F.col("c"), 5)).first()
    assert tuple(row) == (14711, "NACGT")


def test_find_with_mismatches(spark):
    probe = km.kmer_set(frame(spark, "TGATAGTTTTAGAGTTAGGTAG"), "s", 17, mismatches=1)
    found = km.find_first(frame(spark, "TGCCCGTAACGTACAGTTTTACAGTTAGGTACCC"), "id", "s", probe, 17).collect()
    assert [tuple(r) for r in found] == [(0, 14, 31)]


def test_set_algebra(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "kmer string") for xs in ("AB", "BC"))
    values = lambda df: sorted(r[0] for r in df.collect())
    assert [values(f(a, b)) for f in (km.union, km.intersection, km.difference, km.symmetric_difference)] == [["A", "B", "C"], ["B"], ["A"], ["A", "C"]]


def test_consensus(spark):
    sites = oc.per_site_counts(frame(spark, "ACG", "ACGT", "TC", ""), "s", "id")
    assert sites.count() == 3
    assert oc.consensus_text(sites).first()[0] == "ACG"
    assert oc.per_site_counts(frame(spark), "s", "id").count() == 0


def test_frequency_table(spark):
    t = lambda xs: tuple(oc.frequency_table(spark.createDataFrame([(x,) for x in xs], "v int"), "v").first())[1:]
    assert t([0, 255, 1, 3]) == (0, 2.0, 255)
    assert t([24, 129]) == (24, 76.5, 129)


def literal_dp(ref, query, w, go, ge, local):
    """The recurrences cell by cell."""
    n, m, low = len(ref), len(query), -(10**9)
    s = lambda a, b: w.table[w.codes(a)[0]][w.codes(b)[0]]
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0][0] = 0
    for i in range(1, n + 1):
        h[i][0] = 0 if local else go + (i - 1) * ge
    for j in range(1, m + 1):
        h[0][j] = 0 if local else go + (j - 1) * ge
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(e[i - 1][j] + ge, h[i - 1][j] + go)
            f[i][j] = max(f[i][j - 1] + ge, h[i][j - 1] + go)
            h[i][j] = max(h[i - 1][j - 1] + s(ref[i - 1], query[j - 1]), e[i][j], f[i][j], *([0] if local else []))
            best = max(best, h[i][j])
    return best if local else h[n][m]


def test_alignment_goldens():
    w = al.Weights.dna(4, -2)
    a = al.align_pair("GGCCACAGGATTGAG", "CTCAGATTG", w, -3, -1)
    assert (a[1], a[2], a[6]) == (27, 3, "5M1D4M")
    custom = al.Weights.simple("ABCD", 1, -1, rest="A")
    assert al.align_pair("BDAACAABDDDB", "AABDDAB", custom, -4, -2)[1::5] == (5, "5M2S")
    assert al.align_pair("AA", "AGA", al.Weights.dna(10, -10, None), -5, -5)[1] == 15
    assert al.align_pair("A" * 100, "A" * 100, al.Weights.dna(2, -5), -10, -1)[1] == 200
    g = al.align_pair("GGCCACAGGATTGAG", "TACCACAGTATTAG", w, -3, -1, "global")
    assert (g[1], g[6]) == (35, "12M1D2M")
    assert al.align_pair("", "ACG", w, -3, -1, "global")[6] == "3I"
    assert al.align_pair("CCC", "AAA", w, -3, -1)[0] == "Unmapped"
    with pytest.raises(ValueError):
        al.check_gaps(-1, -2)


def test_alignment_random():
    rnd = random.Random(5)
    for _ in range(150):
        ref, query = ("".join(rnd.choice("ACGTN") for _ in range(rnd.randint(1, 14))) for _ in range(2))
        go = -rnd.randint(0, 8)
        ge = -rnd.randint(0, -go)
        w = al.Weights.dna(rnd.randint(1, 5), -rnd.randint(0, 5), rnd.choice(["N", None]))
        for mode in ("local", "global"):
            a = al.align_pair(ref, query, w, go, ge, mode)
            expected = literal_dp(ref, query, w, go, ge, mode == "local")
            assert (a[1] or 0) == expected
            if a[0] == "Some":
                assert al.rescore(ref, query, a[6], a[2], w, go, ge) == expected
                assert al.fill(w.codes(ref), w.codes(query), w.array(), go, ge, mode, trace=False)[0] == expected
        assert al.align_pair(ref, query, w, go, ge, "local", band=20) == al.align_pair(ref, query, w, go, ge)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pre_filter_never_rejects_a_close_pair():
    assert al.may_align("GGTGCAGAGCTC", "GGTGAGAGTTGT", 0.25) is True
    assert al.may_align("ACGT", "ACGT", 1.5) is None
    rnd = random.Random(9)
    for _ in range(400):
        a = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(4, 24)))
        b = "".join(c for c in a if rnd.random() > 0.1) + rnd.choice(["", "A"])
        if not b:
            continue
        t = rnd.choice([0.1, 0.2, 0.3])
        if edit_distance(a, b) <= int(len(b) * t):
            assert al.may_align(a, b, t) is True


def test_align_columns(spark):
    df = spark.createDataFrame([("GGCCACAGGATTGAGC", "TCTCAGATTGCAGTTT"), ("ACGT", None), (None, "A")], "r string, q string")
    a = al.align(F.col("r"), F.col("q"), al.Weights.dna(4, -2), -3, -1)
    rows = df.select(a.alias("a")).withColumn("i", al.invert(F.col("a"))).withColumn("v", al.to_reverse(F.col("a"))).collect()
    assert rows[0]["a"]["cigar"] == "1S5M1D4M1I2M3S"
    assert rows[0]["i"]["cigar"] == "3S5M1I4M1D2M1S"
    assert (rows[0]["a"]["ref_start"], rows[0]["a"]["ref_end"], rows[0]["a"]["query_start"], rows[0]["a"]["query_end"]) == (3, 15, 1, 13)
    assert rows[0]["v"]["cigar"] == "3S2M1I4M1D5M1S"
    assert rows[1]["a"]["cigar"] is None


def test_slices_and_verbose_matching(spark):
    assert al.sliced("4M1D10M3I18M", 0, 33, 35, 9, 27) == (8, 29, "8S6M3I12M6S")
    assert al.sliced("5M", 2, 7, 5, 1, 4) is None
    assert al.sliced("5M", 2, 7, 5, 3, 9) is None
    assert al.sliced("5M", 2, 7, 5, 7, 7) == (0, 0, "5S")
    assert al.sliced("2S5M1D4M", 3, 13, 11, 4, 10) == (3, 8, "3S4M1D1M3S")
    assert al.verbose("ACGTA", "ACCA", "2M1D2M", 0) == "2=1D1X1="
    df = spark.createDataFrame([("GGCCACAGGATTGAG", "CTCAGATTG")], "r string, q string")
    a = df.withColumn("a", al.align(F.col("r"), F.col("q"), al.Weights.dna(4, -2), -3, -1))
    row = a.select(al.slice_to_ref_range(F.col("a"), 4, 11).alias("s"), al.verbose_matching(F.col("r"), F.col("q"), F.col("a")).alias("v")).first()
    assert (row["s"]["ref_start"], row["s"]["ref_end"]) == (4, 11)
    assert row["v"].count("D") == 1 and "M" not in row["v"]


def test_matrix_text():
    w = al.parse_matrix("# c\n  A B\nA 2 -1\nB -1 3\n")
    assert w.table == ((2, -1), (-1, 3))
    with pytest.raises(ValueError):
        al.parse_matrix("A B\n1 2\n")


def test_samplers(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    assert 800 < sp.bernoulli(df, "k", 0.1).count() < 1200
    assert sp.bernoulli(df, "k", 0.1).exceptAll(sp.bernoulli(df.repartition(7), "k", 0.1)).isEmpty()
    assert sp.reservoir(df, "k", 50).distinct().count() == 50
    kept = [r[0] for r in sp.known_size(df, "k", 50).collect()]
    assert kept == sorted(kept) and len(kept) == 50
    with pytest.raises(ValueError):
        sp.known_size(df, "k", 10_001)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n \n>seq1\nATG C   \n>seq2\r\n\n  AC G\r\n T")
    got = [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fasta")).collect()]
    assert got == [("seq1", "ATG C   "), ("seq2", "  AC G T")]
    write_fasta(read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(got)
    (tmp_path / "b.fasta").write_text("ATGC")
    with pytest.raises(Exception, match="malformed FASTA"):
        read_fasta(spark, str(tmp_path / "b.fasta")).collect()
    assert read_fasta(spark, str(tmp_path / "b.fasta"), "DROPMALFORMED").count() == 0
    (tmp_path / "c.fasta").write_text(" \n")
    with pytest.raises(ValueError, match="No FASTA data"):
        read_fasta(spark, str(tmp_path / "c.fasta"))
    tagged = annotated(spark.createDataFrame([("a{x}", "A"), ("b", "C")], "name string, sequence string")).collect()
    assert [tuple(r) for r in tagged] == [("a", "A", "x"), ("b", "C", None)]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n+\n@!~I\n@r2 x\r\nA\r\n+r2\r\n#\r\n")
    records = read_fastq(spark, str(tmp_path / "a.fastq"))
    assert [tuple(r) for r in records.collect()] == [("r1", "ACGT", "@!~I"), ("r2 x", "A", "#")]
    assert reverse_complement(records).first()["quality"] == "I~!@"
    write_fastq(records.coalesce(1), str(tmp_path / "out"))
    assert read_fastq(spark, str(tmp_path / "out")).exceptAll(records).isEmpty()
    for bad in (["r1"], ["@"], ["@r", ""], ["@r", "A", "x"], ["@r", "A", "+"], ["@r", "AC", "+", "!"], ["@r", "A", "+", " "]):
        with pytest.raises(ValueError):
            list(parse(iter(bad)))


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:b\tLN:9", "@SQ\tSN:a\tLN:9", "q1\t0\ta\t5\t60\t2S3M\tc\t1\t2\tACGTA\t*\tAS:i:7\tXX:Z:t", "q2\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*", "q3\t0\tb\t9\t60\t1M\t*\t0\t0\tA\tI", "q4\t0\tz\t1\t60\t1M\t*\t0\t0\tA\tI"]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    records = read_sam(spark, str(tmp_path / "a.sam"))
    order = reference_order(read_sam_header(spark, str(tmp_path / "a.sam")))
    assert [r["qname"] for r in sm.coordinate_sort(records, order).collect()] == ["q3", "q1", "q4", "q2"]
    first = records.where("qname = 'q1'").select(sm.typed(sm.optional(F.col("opt_fields"), "AS"))["int"].alias("score"), sm.to_alignment(F.col("flag"), F.col("pos"), F.col("cigar"), F.col("seq"), F.lit(7), F.lit(9)).alias("a")).first()
    assert first["score"] == 7
    assert (first["a"]["ref_start"], first["a"]["ref_end"], first["a"]["query_start"], first["a"]["query_end"]) == (4, 7, 2, 5)
    assert records.where(sm.is_unmapped(F.col("flag"), F.col("cigar"))).count() == 1
    write_sam(records, str(tmp_path / "out"), read_sam_header(spark, str(tmp_path / "a.sam")))
    assert read_sam(spark, str(tmp_path / "out")).exceptAll(records).isEmpty()
    (tmp_path / "b.sam").write_text("q\t0\ta\n")
    with pytest.raises(Exception, match="malformed SAM"):
        read_sam(spark, str(tmp_path / "b.sam")).collect()
    assert read_sam(spark, str(tmp_path / "b.sam"), "DROPMALFORMED").count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sam").write_text("q\t0\ta\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    run = kmer_count_stream(sam_stream(spark, str(tmp_path / "in")), "seq", 3).writeStream.outputMode("complete").format("memory").queryName("kmers_seen").start()
    try:
        run.processAllAvailable()
        assert {tuple(r) for r in spark.table("kmers_seen").collect()} == {("ACG", 1), ("CGT", 1)}
    finally:
        run.stop()


def test_queries_are_registered():
    from strandlake.plans import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(list(combinations(QUERIES, 1))) >= 30


def test_generated_sequences(spark):
    from strandlake.operators.generate import rand_sequence, random_sequences, split_mix, xoshiro

    # published first numbers: SplitMix64 from 1234567, xoshiro256++ from the state 1, 2, 3, 4
    seeds = split_mix(1234567)
    assert [next(seeds) for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    assert next(xoshiro(0)) == next(xoshiro(0))
    rows = {r["id"]: r["sequence"] for r in random_sequences(spark, 20, 30, seed=7).collect()}
    assert rows == {i: rand_sequence("ACGT", 30, 7 + i) for i in range(20)}
    assert set("".join(rows.values())) == set("ACGT")


def test_byte_index_and_matrices(spark, tmp_path):
    from strandlake.functions.alphabets import AA_PROFILE, DNA_PROFILE, ByteIndex
    from strandlake.functions.composition import coding_gc, min_average_max, min_geomean_max, min_median_max

    df = spark.createDataFrame([("u",), ("C",), ("?",)], "c string")
    assert [r[0] for r in df.select(DNA_PROFILE.to_index(F.col("c"))).collect()] == [3, 1, 4]
    assert [r[0] for r in df.select(DNA_PROFILE.in_keys(F.col("c"))).collect()] == [True, True, False]
    row = spark.createDataFrame([("ACCu?n", "&RV", "ccATGGCGTAAg")], "s string, q string, g string").select(DNA_PROFILE.counts(F.col("s")), min_median_max(F.col("q")), min_geomean_max(F.col("q")), min_average_max(F.col("q")), coding_gc(F.col("g"))).first()
    assert row[0] == [1, 2, 0, 1, 2]
    assert tuple(row[1]) == (5, 49.0, 53)
    assert row[2]["mean"] == pytest.approx(107 / 3, abs=1e-4)
    assert 5 < row[3]["mean"] < 10
    assert tuple(row[4]) == (3, 3, 3, 3)
    assert ByteIndex("AB", "A", False).add_synonym("C", "B").synonyms == (("C", "B"),)
    assert AA_PROFILE.alphabet[-1] == "X"
    (tmp_path / "My_Matrix62.txt").write_text("A B\n1 0\n0 1\n")
    assert al.read_matrix("my matrix-62", str(tmp_path)).alphabet == "AB"
    with pytest.raises(ValueError):
        al.read_matrix("other", str(tmp_path))
