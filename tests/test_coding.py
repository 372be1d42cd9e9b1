"""Coding regions against a literal loop."""

import random

from pyspark.sql import functions as F

from strandlake.functions.composition import coding_gc, coding_regions

STOPS = ("TAA", "TAG", "TGA")


def literal(s):
    regions, outside, rest = [], "", s.upper().replace("U", "T")
    while (at := rest.find("ATG")) >= 0:
        outside, rest = outside + rest[:at], rest[at + 3 :]
        stop = next((i for i in range(0, len(rest) - 2, 3) if rest[i : i + 3] in STOPS), None)
        if stop is None:
            regions.append((rest, None))
            rest = ""
        else:
            regions.append((rest[:stop], rest[stop : stop + 3]))
            rest = rest[stop + 3 :]
    return regions, outside + rest


def gc(s):
    return sum(c in "GC" for c in s)


def test_coding_regions(spark):
    rnd = random.Random(2)
    rows = ["GGATGGCCTAAGGATGCC", "", "ATG", "ATGA", "ATGTAA", "ATGTAAATGTAG", "atgguguaaccc", "GATGATGTGATGA", "ATGC" * 30, "-ATG.N-TAA"]
    rows += ["".join(rnd.choice("ATGATGCNu") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    rows.append("ATG" + "GCC" * 400_000 + "TAAGG")
    out = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", coding_regions(F.col("s")).alias("r"), coding_gc(F.col("s")).alias("g")).collect()
    for r in out:
        regions, outside = literal(rows[r["i"]])
        inside = "".join(b for b, _ in regions)
        assert [tuple(x) for x in r["r"]] == regions
        assert tuple(r["g"]) == (gc(inside), gc(outside), len(inside), len(outside))
    assert (out[0]["g"]["coding"], out[0]["g"]["non_coding"]) == (5, 4)
    assert spark.createDataFrame([(None,)], "s string").select(coding_gc(F.col("s"))["coding"], coding_regions(F.col("s"))).first() == (None, None)


def test_composition_forms_has_the_regions_of_coding_regions(spark):
    from strandlake.plans import QUERIES

    columns = ["doc_id", "bases", "coding", "non_coding"]
    got, expected = (sorted(map(tuple, QUERIES[q](spark, "/root/testdata/sf0.001").select(*columns).collect())) for q in ("composition_forms", "coding_regions"))
    assert got == expected and got
