"""Golden values of the functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions import composition as cp
from strandlake.functions import distance as ds
from strandlake.functions import sequence as sq
from strandlake.functions.alphabets import RECODE, REFINE, VALID, ByteMap, Validator, genetic_code


def one(spark, f, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (sq.reverse_complement, "AtgcnN-", "-NngcaT"),
        (sq.translate, "ATGTCAGATcccagagaaTGAgg", "MSDPRE*~"),
        (lambda c: sq.translate(c, partial="X"), "ATGTCAGATcccagagaaTGAgg", "MSDPRE*X"),
        (lambda c: sq.translate(c, exact=True), "ATGTCAGATcccagagaaTGAgg", "MSDPRE*"),
        (sq.translate, "---A-A...NNNGCNMGRxyz", "-~.XARX"),
        (sq.translate_to_stop, "ATGTGAATG", "M*"),
        (sq.translate_overlapping, "ACGTAATG", "TRV*NM"),
        (lambda c: sq.find_next_aa(c, "M"), "TGGACCGTAACCGATGCACTACCTACGTGAAAGGCGGGCTCCGTCAGTATGAAAA", 13),
        (lambda c: sq.find_next_aa(c, "H"), "TGGACCGTAACCGATGCACTACCTACGTGAAAGGCGGGCTCCGTCAGTATGAAAA", 16),
        (lambda c: sq.find_next_aa(c, "*"), "TGGACCGTAACCGATGCACTACCTACGTGAAAGGCGGGCTCCGTCAGTATGAAAA", 7),
        (lambda c: sq.find_next_aa_in_frame(c, "M", 8), "CCCATGCCCCATGCCATG", 15),
        (lambda c: sq.find_start_codon(c)["start"], "A" * 24 + "augAAA", 24),
        (sq.codons, "ATGTCAGATAC", ["ATG", "TCA", "GAT"]),
        (sq.codon_remainder, "ATGTCAGATAC", "AC"),
        (lambda c: sq.nth_codon(c, 3), "ATGTCAGATAC", None),
        (lambda c: sq.find_substring(c, "")["start"], "ACGT", None),
        (lambda c: sq.find_substring(c, "ACGTA")["start"], "ACGT", None),
        (lambda c: sq.search_in(c, 10, 25, lambda x: sq.find_substring(x, "CACA"))["start"], "CACATAACGTACAGTTTTACACAGTTAGGT", 19),
        (lambda c: sq.find_repeating(c, "T", 4)["start"], "CACATAACGTACAGTTTTACACAG", 14),
        (lambda c: sq.find_last_byte(c, "GC"), "AGCAT", 2),
        (cp.gc_content, "GGCCACCAAGGCCA", 10),
        (cp.median_q, "&RV", 49.0),
        (cp.median_q, "", None),
        (cp.min_q, "!!!", 0),
        (cg.ref_len, "4S10M2I2D3M4H4P", 15),
        (cg.query_len, "4S10M2I2D3M4H4P", 19),
        (cg.ref_len, "3M1D4I8X9=4M", 25),
        (cg.query_len, "3M1D4I8X9=4M", 28),
        (cg.ref_len, "M", 0),
        (cg.is_valid, "10M5I20D", True),
        (cg.is_valid, "M10D", False),
        (cg.is_valid, "10M5I0D", False),
        (cg.is_valid, "10MM5I", False),
        (cg.is_valid, "*", True),
        (cg.is_valid, "18446744073709551616M", False),
        (cg.is_valid, "18446744073709551615M", True),
        (cg.error, "10M5I20", "MissingOp"),
        (cg.error, "0M", "IncZero"),
        (cg.error, "18446744073709551616M", "IncOverflow"),
        (cg.error, "M", "MissingInc"),
        (cg.error, "3Q", "InvalidOperation"),
        (lambda c: cg.of_ciglets(cg.merged(cg.ciglets(c))), "3M2M0D4I1I", "5M5I"),
        (cg.without_clipping, "3H2S5M1S", "5M"),
    ],
)
def test_golden(spark, f, value, expected):
    assert one(spark, f, value) == expected


@pytest.mark.parametrize(("header", "expected"), [("id{clade}", ("id", "clade")), ("id2{clade1}{clade2}", ("id2", "clade2")), ("id3{{clade}}", ("id3", "clade")), ("id4{}", None), ("id5_clade", None), ("", None)])
def test_id_taxon(spark, header, expected):
    got = one(spark, sq.id_taxon, header)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("needle", "k"), [("TCCTCATAAG", 0), ("TCCTTATAAG", 1), ("TCATTATAAG", 2)])
def test_fuzzy(spark, needle, k):
    hay = "ATAGATTTCTGCTACTCTCCTCATAAGCAGTCCGGTGTATCGAAAGTACA"
    assert one(spark, lambda c: sq.find_fuzzy(c, needle, k)["start"], hay) == 17


def test_fuzzy_brute_force(spark):
    rnd = random.Random(3)
    rows = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    for needle in ("ACGTA", "AAAA", "GC"):
        for k in (0, 1, 2, 6):
            got = [r[0] for r in df.select(sq.find_fuzzy(F.col("s"), needle, k)["start"]).collect()]
            n = len(needle)
            assert got == [next((i for i in range(len(s) - n + 1) if sum(a != b for a, b in zip(s[i : i + n], needle, strict=True)) <= k), None) for s in rows]


def test_maps_agree_with_python(spark):
    text = "".join(map(chr, range(32, 127)))
    for table in (RECODE, REFINE):
        for name, m in table.items():
            assert one(spark, m.apply, text) == m.of(text), name
    for name, v in VALID.items():
        assert one(spark, v.retain, text) == "".join(c for c in text if c in v.chars), name
        assert one(spark, v.is_valid, v.text) is True
        assert one(spark, v.is_valid, "") is True
        assert one(spark, v.is_valid, "é") is False


def test_builders(spark):
    assert one(spark, Validator().add_range("a", "e").remove("c").retain, "abcdef") == "abde"
    assert one(spark, ByteMap("?").map("ab", "xy").preserve("c").apply, "abcd") == "xyc?"
    assert one(spark, ByteMap().map_to_one("ab", "").apply, "abc") == "c"


def test_genetic_code():
    code = genetic_code()
    assert code["RAY" if "RAY" in code else "YTR"] == "L"
    assert (code["TRA"], code["URA"], code["MGR"], code["ATH"], code["NNN"], code["..-"], code["---"]) == ("*", "*", "R", "I", "X", ".", "-")
    assert "RAY" not in code
    assert "ATU" not in code


LONG = ("ATCGATCGATCG", "ATCGATCGATCA")


def test_distances(spark):
    def m(f):
        return one(spark, lambda a, b: getattr(ds.Matrix(ds.substitution_matrix(a, b)), f)(), *LONG)

    assert m("hamming") == 1
    assert m("jc69") == pytest.approx(0.0883372767, abs=1e-9)
    assert m("k80") == pytest.approx(0.0911607783, abs=1e-9)
    assert m("k81") == pytest.approx(0.0911607783969773, abs=1e-12)
    assert m("f81") == pytest.approx(0.0883624618660489, abs=1e-12)
    assert m("tn93") == pytest.approx(0.1020478096, abs=1e-9)
    assert one(spark, lambda a, b: ds.Matrix(ds.substitution_matrix(a, b)).jc69(), "ACGT", "ACGT") == 0
    assert one(spark, lambda a, b: ds.Matrix(ds.substitution_matrix(a, b)).jc69(), "ACGT", "") is None
    assert one(spark, ds.substitution_matrix, "GATCAGATTTGCATTGGTT", "GATCATATTAGCATTGCTT") == [4, 0, 0, 1, 0, 2, 1, 0, 0, 0, 3, 0, 0, 0, 1, 7]
    assert one(spark, ds.p_distance_acgt, "ATGCATGC", "atgtttnc") == pytest.approx(2 / 7)
    assert one(spark, ds.hamming, "ATGCATCGATCGATCGATCGATCGATCGATGC", "ATGCATnGATCGATCGATCGAnCGATCGATnC") == 3
    assert one(spark, ds.hamming, "MANATEEMANATEEMANATEE", "MANGAEEMANATEEMANGAEE") == 4


@pytest.mark.parametrize(("a", "b", "expected"), [("MANATEEMANATEEMANATEE", "MANGAEEMANATEEMANGAEE", 0.7643302), ("MANATEE", "MANGAEE", 1.1464952), ("MA?A", "MA?A", 0.0)])
def test_physiochemical(spark, a, b, expected):
    got = one(spark, ds.physiochemical, a, b)
    assert got["distance"] == pytest.approx(expected, abs=1e-6)
    assert got["error"] is None


def test_physiochemical_errors(spark):
    assert tuple(one(spark, ds.physiochemical, "???", "???")) == (None, "NotComparable")
    assert tuple(one(spark, ds.physiochemical, "", "M")) == (None, "NoData")


def test_counts_and_plurality(spark):
    c = one(spark, cp.base_counts, "AaCGtUN-.RX?")
    assert tuple(c) == (2, 1, 1, 2, 1, 1, 2, 2)
    for text, best in (("ACCCCCCCCGGGGGTTN", "C"), ("AACGGGTNNN", "G"), ("ACGTN", "A"), ("", "A"), ("NNNNN", "N")):
        assert one(spark, lambda x: cp.plurality_acgtn(cp.base_counts(x)), text) == best


def test_windows(spark):
    assert one(spark, lambda c: sq.stepped_windows(c, 4, 3), "ABCDEFGHI") == ["ABCD", "DEFG"]
    assert one(spark, lambda c: sq.final_partial_window(c, 4, 3), "ABCDEFGHI") == "GHI"
    assert one(spark, lambda c: sq.stepped_windows(c, 4, 3), "ABC") == []


def test_aligned_pair(spark):
    got = one(spark, lambda r, q, c: cg.aligned_pair(r, q, c, F.lit(3)), "GGCCACAGGATTGAG", "CTCAGATTG", "5M1D4M")
    assert got["ref"] == "CACAGGATTG"
    assert re.sub("-", "", got["query"]) == "CTCAGATTG"
