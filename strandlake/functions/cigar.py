"""CIGAR strings as native expressions, but for gapped rows. A ciglet is a struct (inc, op)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
REF_OPS, QUERY_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")
LARGEST = "18446744073709551615"


def _incs(col: Column) -> Column:
    """The lengths, without leading zeros."""
    return F.transform(F.regexp_extract_all(col, F.lit("[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+", ""))


def _fits(inc: Column) -> Column:
    return (F.length(inc) < len(LARGEST)) | ((F.length(inc) == len(LARGEST)) & (inc <= LARGEST))


def is_valid(col: Column) -> Column:
    """Empty, ``*``, or non-zero lengths with known operations, none too large."""
    shape = col.rlike(rf"^(\*|([0-9]*[1-9][0-9]*[{OPS}])*)\z")
    return shape & F.forall(_incs(col), _fits)


def error(col: Column) -> Column:
    """Why a string is not a CIGAR: the first of its faults from the left, else null."""
    head = F.regexp_extract(col, rf"^(?:[0-9]*[1-9][0-9]*[{OPS}])*", 0)
    rest = F.substring(col, F.length(head) + 1, F.length(col))
    number = F.regexp_extract(rest, "^[0-9]+", 0)
    op = F.substring(rest, F.length(number) + 1, F.lit(1))
    whole = F.when(rest == "", None).when(op == "", "MissingOp").when(number == "", F.when(op.rlike(rf"[{OPS}]"), "MissingInc").otherwise("InvalidOperation")).when(~op.rlike(rf"[{OPS}]"), "InvalidOperation").otherwise("IncZero")
    too_large = F.when(F.exists(_incs(col), lambda x: ~_fits(x)), "IncOverflow")
    return F.when(col.isin("", "*"), None).otherwise(F.coalesce(too_large, whole))


def ciglets(col: Column) -> Column:
    """All (inc, op) up to the first malformed place."""
    parts = F.regexp_extract_all(col, F.lit(rf"\G[0-9]+[{OPS}]"), F.lit(0))  # each where the one before it ends; a repeated group would need a stack
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).try_cast("bigint").alias("inc"), F.substring(p, F.length(p), F.lit(1)).alias("op")))


# These take the string, or with ``parsed`` a column of its ciglets: several of them then parse a string once.


def _ops(col: Column, parsed: bool) -> Column:
    return col if parsed else ciglets(col)


def _length(col: Column, ops: tuple[str, ...], parsed: bool) -> Column:
    return F.aggregate(_ops(col, parsed), F.lit(0).cast("bigint"), lambda a, c: F.when(c["op"].isin(*ops), a + c["inc"]).otherwise(a))


def ref_len(col: Column, parsed: bool = False) -> Column:
    return _length(col, REF_OPS, parsed)


def query_len(col: Column, parsed: bool = False) -> Column:
    return _length(col, QUERY_OPS, parsed)


def has_indels(col: Column, parsed: bool = False) -> Column:
    return F.exists(_ops(col, parsed), lambda c: c["op"].isin("I", "D"))


def expanded(col: Column, parsed: bool = False) -> Column:
    """One operation a base."""
    return F.array_join(F.transform(_ops(col, parsed), lambda c: F.repeat(c["op"], c["inc"].cast("int"))), "")


def of_ciglets(states: Column) -> Column:
    return F.array_join(F.transform(states, lambda c: F.concat(c["inc"].cast("string"), c["op"])), "")


def merged(states: Column) -> Column:
    """Ciglets with equal neighbours made one and empty ones left out."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["inc"] + c["inc"]).alias("inc"), c["op"].alias("op"))))
        same = F.when(F.size(acc) > 0, last["op"] == c["op"]).otherwise(F.lit(False))
        return F.when(c["inc"] == 0, acc).when(same, joined).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(states, F.array().cast("array<struct<inc: bigint, op: string>>"), step)


def reversed_cigar(col: Column, parsed: bool = False) -> Column:
    return of_ciglets(F.reverse(_ops(col, parsed)))


def clipped(col: Column) -> Column:
    """(start, end): how many bases of the query soft clips take at both ends."""
    lead, trail = F.regexp_extract(col, r"^(?:[0-9]+[HS])+", 0), F.regexp_extract(without_leading_clips(col), r"(?:[0-9]+[HS])+\z", 0)
    total = lambda x: F.aggregate(F.filter(ciglets(x), lambda c: c["op"] == "S"), F.lit(0).cast("bigint"), lambda a, c: a + c["inc"])
    return F.struct(total(lead).alias("start"), total(trail).alias("end"))


def without_leading_clips(col: Column) -> Column:
    return F.regexp_replace(col, r"^(?:[0-9]+[HS])+", "")


def without_clipping(col: Column) -> Column:
    """Without hard and soft clips at both ends."""
    return F.regexp_replace(F.regexp_replace(col, r"^(?:[0-9]+[HS])+", ""), r"(?:[0-9]+[HS])+\z", "")


def prefix_sums(numbers: Column) -> Column:
    """The sums of all numbers before each one and of them all, by doubling strides: n log n steps for n numbers (up to 2^24)."""
    zero = F.lit(0).cast("bigint")

    def doubled(stride: int):
        # a stride beyond the array's end leaves it as it is
        return lambda x: F.when(F.size(x) > stride, F.transform(x, lambda v, i: v + F.coalesce(F.get(x, i - stride), zero))).otherwise(x)

    out = F.concat(F.array(zero), numbers)
    for j in range(24):  # each step's array is bound once, by a lambda over the one element that it is
        out = F.get(F.transform(F.array(out), doubled(1 << j)), F.lit(0))
    return out


def cursors(cigar: Column, ref_start: Column) -> Column:
    """Each operation with the places where it begins, as (inc, op, ref, query)."""
    steps = F.array(ciglets(cigar))

    def placed(ops: Column) -> Column:
        used = lambda which: prefix_sums(F.transform(ops, lambda c: F.when(c["op"].isin(*which), c["inc"]).otherwise(F.lit(0).cast("bigint"))))
        sums = F.array(F.struct(used(REF_OPS).alias("r"), used(QUERY_OPS).alias("q")))
        return F.get(F.transform(sums, lambda s: F.transform(ops, lambda c, i: F.struct(c["inc"].alias("inc"), c["op"].alias("op"), (ref_start + F.get(s["r"], i)).alias("ref"), F.get(s["q"], i).alias("query")))), F.lit(0))

    return F.get(F.transform(steps, placed), F.lit(0))


def aligned_pair(ref: Column, query: Column, cigar: Column, ref_start: Column) -> Column:
    """(ref, query) with gaps: ``-`` in the query for D, in the reference for I, N for N; S skips the query; H and P nothing.

    One pass over the operations of each row, in Arrow batches: as expressions this took a millisecond a row.
    """
    from strandlake.shipping import ship

    ship()

    @F.pandas_udf("ref string, query string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = [gapped(w, x, y, int(z)) if isinstance(w, str) and isinstance(x, str) and isinstance(y, str) and z == z and z is not None else (None, None) for w, x, y, z in zip(a, b, c, start, strict=True)]
        return pd.DataFrame(rows, columns=["ref", "query"], dtype=object)

    return run(ref, query, cigar, ref_start.cast("bigint"))


_CIGLET = re.compile(f"([0-9]+)([{OPS}])")


def _parsed(cigar: str) -> list[tuple[int | None, str]]:
    """As ``ciglets``: up to the first malformed place, None for a length beyond 64 bits."""
    out, at = [], 0
    while found := _CIGLET.match(cigar, at):
        n, at = int(found[1]), found.end()
        out.append((n if n < 1 << 63 else None, found[2]))
    return out


def gapped(ref: str, query: str, cigar: str, ref_start: int) -> tuple[str, str]:
    """Both rows of one alignment."""
    r, q = ref_start, 0
    of_ref, of_query = [], []
    cut = lambda x, at, n: "" if at is None or n is None else x[max(at, 0) : max(at + n, 0)]
    for n, op in _parsed(cigar):
        filled = n or 0
        of_ref.append(cut(ref, r, n) if op in REF_OPS else "-" * filled if op == "I" else "")
        of_query.append(cut(query, q, n) if op in "MI=X" else "-" * filled if op == "D" else "N" * filled if op == "N" else "")
        if op in REF_OPS:
            r = None if r is None or n is None else r + n
        if op in QUERY_OPS:
            q = None if q is None or n is None else q + n
    return "".join(of_ref), "".join(of_query)


def inverted(cigar: Column) -> Column:
    """Insertions and deletions exchanged; clips belong to one side and go."""
    return F.translate(without_clipping(cigar), "ID", "DI")
