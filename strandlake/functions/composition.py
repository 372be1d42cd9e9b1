"""Base composition as native expressions, and Phred quality; statistics of scores are made in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import batches

SLOTS = ("a", "c", "g", "t", "n", "gap", "other", "invalid")
#: The characters of each slot but the last; a dot counts as other, not as a gap.
_SLOT_CHARS = {"a": "Aa", "c": "Cc", "g": "Gg", "t": "TtUu", "n": "Nn", "gap": "\\-", "other": "RYSWKMBDHVryswkmbdhv."}


def _count(col: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{chars}]+", "")).cast("bigint")


def gc_content(col: Column) -> Column:
    """How many bases are G or C."""
    return _count(col, "GCgc")


def base_counts(col: Column) -> Column:
    """A struct of the eight tallies."""
    known = {k: _count(col, v) for k, v in _SLOT_CHARS.items()}
    invalid = F.length(F.regexp_replace(col, "[" + "".join(_SLOT_CHARS.values()) + "]+", "")).cast("bigint")
    return F.struct(*[v.alias(k) for k, v in known.items()], invalid.alias("invalid"))


def total(counts: Column, *slots: str) -> Column:
    out = counts[slots[0]]
    for s in slots[1:]:
        out = out + counts[s]
    return out


def totals(counts: Column) -> Column:
    """AT, GC, ACGT, with N, with gaps, all valid, all."""
    c = ("a", "c", "g", "t")
    return F.struct(total(counts, "a", "t").alias("at"), total(counts, "g", "c").alias("gc"), total(counts, *c).alias("acgt"), total(counts, *c, "n").alias("acgtn"), total(counts, *c, "n", "gap").alias("acgtn_gap"), total(counts, *SLOTS[:7]).alias("valid"), total(counts, *SLOTS).alias("any"))


def plurality_acgtn(counts: Column) -> Column:
    """The most frequent of A, C, G, T and N; of equal ones the first."""
    best = F.greatest(*[counts[s] for s in SLOTS[:5]])
    out = F.when(counts["a"] == best, "A")
    for s in SLOTS[1:4]:
        out = out.when(counts[s] == best, s.upper())
    return out.otherwise("N")


def phred(col: Column) -> Column:
    """Scores of a quality string."""
    return F.when(F.length(col) > 0, F.transform(F.split(col, ""), lambda c: F.ascii(c) - 33)).otherwise(F.array().cast("array<int>"))


def min_q(col: Column) -> Column:
    return batches.score_statistics(col)["min"]


def max_q(col: Column) -> Column:
    return batches.score_statistics(col)["max"]


def median_q(col: Column) -> Column:
    """The median score; of an even number the mean of the middle two; null if there is none."""
    return batches.score_statistics(col)["median"]


def geometric_mean_q(col: Column) -> Column:
    """The mean of the scores, which is that of the geometric mean of the errors."""
    return batches.score_statistics(col)["geometric_mean"]


def arithmetic_mean_q(col: Column) -> Column:
    """The score of the mean error."""
    return batches.score_statistics(col)["arithmetic_mean"]


def error_of_q(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0).cast("float")


def q_of_error(p: Column) -> Column:
    return (-10 * F.log10(p)).cast("float")


def min_median_max(col: Column) -> Column:
    return F.struct(min_q(col).alias("min"), median_q(col).alias("median"), max_q(col).alias("max"))


def min_geomean_max(col: Column) -> Column:
    return F.struct(min_q(col).alias("min"), geometric_mean_q(col).alias("mean"), max_q(col).alias("max"))


def min_average_max(col: Column) -> Column:
    return F.struct(min_q(col).alias("min"), arithmetic_mean_q(col).alias("mean"), max_q(col).alias("max"))


#: A start codon, the codons up to the next stop in its frame, and that stop, or else all that is left.
_REGION = "(?s)ATG((?:(?!TAA|TAG|TGA)...)*+)(TAA|TAG|TGA|.{0,2}\\z)"


def coding_regions(col: Column) -> Column:
    """All regions of a sequence, from left to right, as (bases, stop): what lies between a start codon and the next stop in its frame.

    A region without a stop takes the rest of the sequence, an incomplete codon too, and its stop is null. The next region is
    looked for behind the stop, in any frame.
    """
    up = F.translate(F.upper(col), "U", "T")
    codons, last = (F.regexp_extract_all(up, F.lit(_REGION), F.lit(i)) for i in (1, 2))
    return F.zip_with(codons, last, lambda c, s: F.when(F.length(s) == 3, F.struct(c.alias("bases"), s.alias("stop"))).otherwise(F.struct(F.concat(c, s).alias("bases"), F.lit(None).cast("string").alias("stop"))))


def coding_gc(col: Column) -> Column:
    """(coding, non_coding, coding_bases, non_coding_bases): G and C, and all bases, inside and outside the coding regions.

    Start and stop codons count for neither.
    """
    up = F.translate(F.upper(col), "U", "T")
    inside = F.array_join(F.transform(coding_regions(col), lambda r: r["bases"]), "")
    outside = F.regexp_replace(up, _REGION, "")
    return F.struct(gc_content(inside).alias("coding"), gc_content(outside).alias("non_coding"), F.length(inside).cast("bigint").alias("coding_bases"), F.length(outside).cast("bigint").alias("non_coding_bases"))
