"""K-mers as rows: sets, counts, mismatch variants, set algebra and search.

A k-mer is a string over NACGT (three-bit encoding, others become N) or ACGT (two-bit, others become A). Everything is
native: sequences are cut into short pieces, windows are generated from these and counted with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.alphabets import KMER2, KMER3

ALPHABET = "NACGT"
MAX_THREE_BIT, MAX_TWO_BIT = 42, 64
#: Bases of the pieces that sequences are cut into.
PIECE = 128


def normal(seq: Column, bits: int = 3) -> Column:
    return (KMER3 if bits == 3 else KMER2).apply(seq)


def check_length(k: int, bits: int = 3) -> int:
    if not 2 <= k <= (MAX_THREE_BIT if bits == 3 else MAX_TWO_BIT):
        raise ValueError(f"k-mer length {k} is not supported")
    return k


def windows(seq: Column, k: int, bits: int = 3, reverse: bool = False) -> Column:
    """All k-mers in an array, left to right or right to left."""
    check_length(k, bits)
    out = F.regexp_extract_all(normal(seq, bits), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.reverse(out) if reverse else out


def kmers(df: DataFrame, seq: str, k: int, *, bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each k-mer: the kept columns, its 0-based position and the k-mer.

    Sequences are cut into pieces of ``PIECE`` bases, each with the first k - 1 of the next, so that a window is cut from a
    short string: the cost is proportional to the length, and no array holds more than a piece's windows.
    """
    taken = {c.lower() for c in keep}
    n, cut_, at_, pos = (next(x for x in (base + "_" * i for i in range(len(taken) + 1)) if x not in taken) for base in ("_n", "_cut", "_at", "_pos"))
    base = df.select(*keep, normal(F.col(seq), bits).alias(n)).where(F.length(n) >= check_length(k, bits))
    cut = F.regexp_extract_all(n, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    base = base.select(*keep, cut.alias(cut_))
    whole = F.transform(cut_, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(cut_, i + 1), 1, k - 1), F.lit(""))))
    pieces = base.select(*keep, F.posexplode(whole).alias(at_, n)).where(F.length(n) >= k)
    at = pieces.select(*keep, at_, n, F.explode(F.sequence(F.lit(0), F.length(n) - k)).alias(pos))
    return at.select(*keep, (F.col(at_) * PIECE + F.col(pos)).alias("pos"), F.substr(n, F.col(pos) + 1, F.lit(k)).alias("kmer"))


def kmer_set(df: DataFrame, seq: str, k: int, *, bits: int = 3, mismatches: int = 0) -> DataFrame:
    out = kmers(df, seq, k, bits=bits).select("kmer").distinct()
    return out.select(F.explode(variants(F.col("kmer"), k, mismatches)).alias("kmer")).distinct() if mismatches else out


def kmer_counts(df: DataFrame, seq: str, k: int, *, bits: int = 3, mismatches: int = 0) -> DataFrame:
    """(kmer, count); with mismatches each k-mer counts for all its variants. Counted before they are expanded."""
    out = kmers(df, seq, k, bits=bits).groupBy("kmer").agg(F.count("*").alias("count"))
    if mismatches:
        out = out.select(F.explode(variants(F.col("kmer"), k, mismatches)).alias("kmer"), "count").groupBy("kmer").agg(F.sum("count").alias("count"))
    return out


def variants(kmer: Column, k: int, n: int) -> Column:
    """All k-mers over NACGT within n substitutions, each once, the original included."""
    out = F.array(kmer)
    for _ in range(n):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.array(*[F.concat(F.substring(x, 1, i), F.lit(b), F.substring(x, i + 2, k)) for i in range(k) for b in ALPHABET]))))
    return out


def encode(kmer: Column, bits: int = 3) -> Column:
    """The packed number as a long, up to 21 bases of three bits or 32 of two (a full 64 bits, so it may be negative)."""
    most, code = (21, F.conv(F.translate(kmer, "NACGT", "34567"), 8, -10)) if bits == 3 else (32, F.conv(F.translate(kmer, "ACGT", "0123"), 4, -10))
    return F.when(F.length(kmer) <= most, code.cast("bigint")).when(kmer.isNotNull(), F.raise_error("k-mers of this length are packed by encode_wide").cast("bigint"))


def decode(code: Column, k: int, bits: int = 3) -> Column:
    if bits == 3:
        return F.translate(F.conv(code.cast("string"), 10, 8), "34567", "NACGT")
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


#: The bits of each letter.
BITS = {3: {"N": "011", "A": "100", "C": "101", "G": "110", "T": "111"}, 2: {"A": "00", "C": "01", "G": "10", "T": "11"}}


def encode_wide(kmer: Column, bits: int = 3) -> Column:
    """The packed number of any length (up to 42 bases of three bits, 64 of two) as a struct (high, low) of its 64-bit halves."""
    letters = F.split(kmer, "")
    table = F.create_map(*[F.lit(x) for pair in BITS[bits].items() for x in pair])
    text = F.lpad(F.array_join(F.transform(letters, lambda c: F.try_element_at(table, c)), ""), 128, "0")
    half = lambda at: F.conv(F.substring(text, at, 64), 2, -10).cast("bigint")
    return F.when(kmer.isNotNull(), F.struct(half(1).alias("high"), half(65).alias("low")))


def decode_wide(code: Column, k: int, bits: int = 3) -> Column:
    half = lambda x: F.lpad(F.conv(F.hex(x), 16, 2), 64, "0")
    text = F.substring(F.concat(half(code["high"]), half(code["low"])), 128 - bits * k + 1, bits * k)
    table = F.create_map(*[F.lit(x) for a, b in BITS[bits].items() for x in (b, a)])
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f".{{{bits}}}"), F.lit(0)), lambda c: F.try_element_at(table, c)), "")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").union(b.select("kmer")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").intersect(b.select("kmer"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").subtract(b.select("kmer"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only one side has, by one aggregation."""
    sides = a.select("kmer", F.lit(1).alias("s")).union(b.select("kmer", F.lit(2).alias("s")))
    return sides.groupBy("kmer").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo = hi").select("kmer")


def contains(probe: DataFrame, collection: DataFrame) -> DataFrame:
    """The probe's rows with a column ``count``: how often the collection has the k-mer, 0 if not at all."""
    counted = collection if "count" in collection.columns else collection.select("kmer").distinct().withColumn("count", F.lit(1).cast("bigint"))
    return probe.join(counted.select("kmer", "count"), "kmer", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def find_all(df: DataFrame, id_: str, seq: str, collection: DataFrame, k: int, *, bits: int = 3) -> DataFrame:
    """(id, start, end) of every place whose k-mer is in the collection; Spark broadcasts the collection if it is small."""
    found = kmers(df, seq, k, bits=bits, keep=(id_,)).join(collection.select("kmer").distinct(), "kmer", "left_semi")
    return found.select(id_, F.col("pos").cast("bigint").alias("start"), (F.col("pos") + k).cast("bigint").alias("end"))


def find_ends(df: DataFrame, id_: str, seq: str, collection: DataFrame, k: int, *, bits: int = 3) -> DataFrame:
    """(id, first_start, last_start, last_end): the leftmost and the rightmost place of each row, in one pass."""
    ends = find_all(df, id_, seq, collection, k, bits=bits).groupBy(id_).agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"))
    return ends.withColumn("last_end", F.col("last_start") + k)


def find_first(df: DataFrame, id_: str, seq: str, collection: DataFrame, k: int, *, bits: int = 3, reverse: bool = False) -> DataFrame:
    """The leftmost place of each row, or the rightmost."""
    pick = F.max("start") if reverse else F.min("start")
    return find_all(df, id_, seq, collection, k, bits=bits).groupBy(id_).agg(pick.alias("start")).select(id_, "start", (F.col("start") + k).alias("end"))
