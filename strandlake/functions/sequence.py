"""Sequence columns: validation, recoding, slicing, translation and search. All expressions are native.

Positions are 0-based and ranges half-open; a range is a struct (start, end), null where nothing is found.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import batches
from strandlake.functions.alphabets import AMBIGUITY, COMPLEMENT, RECODE, REFINE, VALID, ByteMap, both_cases, char_class, genetic_code


def _lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Validation ---------------------------------------------------------------------------------------------------------


def is_valid_dna(col: Column, strategy: str) -> Column:
    return VALID[strategy].is_valid(col)


def is_acgtn_uc(col: Column) -> Column:
    return is_valid_dna(col, "acgtn_no_gaps_uc")


def retain_dna(col: Column, strategy: str) -> Column:
    return VALID[strategy].retain(col)


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def is_graphic(col: Column) -> Column:
    return col.rlike(r"^[!-~]*\z")


def maybe_base(col: Column, bases: str) -> Column:
    """Whether a one-letter column may stand for any of the bases."""
    return col.isin([c for k, v in AMBIGUITY.items() if set(v) & set(bases) for c in both_cases(k)])


# Recoding -----------------------------------------------------------------------------------------------------------


def recode_dna(col: Column, strategy: str) -> Column:
    return batches.mapped(col, RECODE[strategy])


def recode_dna_reads(col: Column) -> Column:
    return recode_dna(col, "any_to_acgtn_no_gaps_upper")


def recode_dna_aligned(col: Column) -> Column:
    return recode_dna(col, "any_to_iupac_correct_gaps_upper")


def retain_and_recode_dna(col: Column, strategy: str) -> Column:
    return batches.mapped(col, REFINE[strategy])


def filter_to_dna(col: Column) -> Column:
    return retain_and_recode_dna(col, "iupac_correct_gaps_uc")


def filter_to_dna_unaligned(col: Column) -> Column:
    return retain_and_recode_dna(col, "iupac_no_gaps_uc")


def make_uppercase(col: Column) -> Column:
    return ByteMap().map_range("a", "z", "A").apply(col)


def refine_base(col: Column, strategy: str) -> Column:
    """A one-letter column; null where it is dropped."""
    return F.nullif(retain_and_recode_dna(col, strategy), F.lit(""))


def mask_if_exists(col: Column, start: int | Column, end: int | Column, by: str = "N") -> Column:
    """The range overwritten, if all of it exists."""
    s, e = _lit(start), _lit(end)
    inside = (s >= 0) & (s <= e) & (e <= F.length(col))
    return F.when(inside, F.concat(F.substring(col, F.lit(1), s), F.repeat(F.lit(by), e - s), F.substring(col, e + 1, F.length(col)))).otherwise(col)


def replace_all_bytes(col: Column, old: str, new: str) -> Column:
    return F.translate(col, old, new)


# Scalars ------------------------------------------------------------------------------------------------------------


def reverse_complement(col: Column) -> Column:
    a, b = COMPLEMENT
    return F.reverse(F.translate(col, a + a.lower(), b + b.lower()))


def shorten_to(col: Column, n: int | Column) -> Column:
    return F.substring(col, F.lit(1), _lit(n))


def cut_to_start(col: Column, n: int | Column) -> Column:
    """Without the first n; null where there are fewer."""
    return F.when(_lit(n) <= F.length(col), F.substring(col, _lit(n) + 1, F.length(col)))


def pad(col: Column, by: str, before: int = 0, after: int = 0) -> Column:
    return F.concat(F.lit(by * before), col, F.lit(by * after))


def slice_range(col: Column, start: int | Column, end: int | Column) -> Column:
    """The range; null unless all of it exists."""
    s, e = _lit(start), _lit(end)
    return F.when((s >= 0) & (s <= e) & (e <= F.length(col)), F.substring(col, s + 1, e - s))


def chop_stop(col: Column) -> Column:
    return F.regexp_replace(col, r"\*\z", "")


def nth_codon(col: Column, n: int | Column) -> Column:
    """Codon n from 0; null if the sequence is too short."""
    return slice_range(col, _lit(n) * 3, _lit(n) * 3 + 3)


def last_codon(col: Column) -> Column:
    return F.when(F.length(col) >= 3, nth_codon(col, F.floor(F.length(col) / 3).cast("int") - 1))


def tail_codon(col: Column) -> Column:
    """The last three bases whatever their frame."""
    return F.when(F.length(col) >= 3, F.substring(col, F.length(col) - 2, F.lit(3)))


def codons(col: Column) -> Column:
    """Full codons in frame 0."""
    return F.regexp_extract_all(col, F.lit("(?s)..."), F.lit(0))


def codon_remainder(col: Column) -> Column:
    return F.substring(col, F.length(col) - F.length(col) % 3 + 1, F.lit(3))


def id_taxon(header: Column) -> Column:
    """(id, taxon) of a header: the text before the first brace, and that between the last brace and the next closing one; null if either is missing."""
    last = F.substring_index(header, "{", -1)
    taxon = F.when(F.contains(header, F.lit("{")) & F.contains(last, F.lit("}")), F.nullif(F.substring_index(last, "}", 1), F.lit("")))
    id_ = F.nullif(F.substring_index(header, "{", 1), F.lit(""))
    return F.when(taxon.isNotNull() & id_.isNotNull(), F.struct(id_.alias("id"), taxon.alias("taxon")))


def strip_line_breaks(col: Column) -> Column:
    return F.translate(col, "\r\n", "")


# Translation --------------------------------------------------------------------------------------------------------


#: Letters that take part in the code; others count as unknown.
_LETTERS = "ACGTRYSWKMBDHVNU-."


def _table(partial: str | None) -> Column:
    """Residues of all triples of letters (0: unknown): for each pair of first letters a string by the third, a constant array."""
    code, rows = genetic_code(), []
    for first in product(("?", *_LETTERS), repeat=2):
        row = ""
        for third in ("?", *_LETTERS):
            codon = "".join((*first, third))
            row += partial if partial is not None and sum(c in "-." for c in codon) in (1, 2) else code.get(codon, "X")
        rows.append(row)
    return F.split(F.lit(" ".join(rows)), " ")


def _place(col: Column, table: Column) -> Column:
    i, j, k = (F.position(F.substring(col, p, 1), F.lit(_LETTERS)) for p in (1, 2, 3))
    return F.substring(F.element_at(table, i * (len(_LETTERS) + 1) + j + 1), k + 1, F.lit(1))


def is_partial_codon(codon: Column) -> Column:
    """One or two gap characters of three, or fewer than three characters."""
    gaps = F.length(F.regexp_replace(codon, r"[^.\-]", ""))
    return gaps.isin(1, 2) & (F.length(codon) == 3) | F.length(codon).isin(1, 2)


def translate_codon(codon: Column, partial: str | None = None) -> Column:
    """The residue of a codon, X where it cannot be resolved; with ``partial`` this letter for partial codons."""
    return F.when(F.length(codon) >= 3, _place(F.upper(codon), _table(partial))).otherwise(F.lit(partial))


def get_amino_acid(codon: Column) -> Column:
    """The residue of a codon, null where it cannot be resolved (NNN gives X)."""
    return F.when((translate_codon(codon) != "X") | (F.upper(codon) == "NNN"), translate_codon(codon))


def translate(col: Column, partial: str = "~", exact: bool = False) -> Column:
    """Residues of all codons in frame 0; a trailing partial codon counts unless ``exact``."""
    body = batches.residues(F.upper(col), partial, 3)
    return body if exact else F.concat(body, F.when(F.length(col) % 3 > 0, F.lit(partial)).otherwise(F.lit("")))


def translate_to_stop(col: Column) -> Column:
    """The translation up to and with the first stop."""
    return F.regexp_extract(translate(col), r"^[^*]*\*?", 0)


def translate_overlapping(col: Column) -> Column:
    """The residue of each window of three, in all frames."""
    return batches.residues(F.upper(col), None, 1)


def _from(col: Column, start: int) -> Column:
    return F.substring(col, start + 1, 1 << 30) if start > 0 else col


def find_next_aa(col: Column, aa: str, start: int = 0) -> Column:
    """The first base from ``start`` on whose window of three translates to aa, in any frame."""
    return _found(F.locate(aa.upper(), translate_overlapping(_from(col, start))), start)


def find_next_aa_in_frame(col: Column, aa: str, start: int = 0) -> Column:
    """The first base of a codon, in the frame of the whole sequence, from ``start`` on that translates to aa."""
    begin = -(-start // 3) * 3
    at = F.locate(aa.upper(), translate(_from(col, begin), exact=True))
    return F.when(at > 0, (at - 1) * 3 + begin)


def find_start_codon(col: Column) -> Column:
    return _range(F.locate("ATG", F.translate(F.upper(col), "U", "T")), F.lit(3))


def is_std_stop_codon(codon: Column) -> Column:
    return F.upper(F.substring(codon, 1, 3)).isin([k for k, v in genetic_code().items() if v == "*"])


def maybe_std_stop_codon(codon: Column) -> Column:
    """Whether some reading of the codon is a stop."""
    a, b, c = (F.substring(codon, i, 1) for i in (1, 2, 3))
    return maybe_base(a, "T") & maybe_base(b, "AG") & maybe_base(c, "AG") & (maybe_base(b, "A") | maybe_base(c, "A"))


def is_resolvable_codon(codon: Column) -> Column:
    return get_amino_acid(codon).isNotNull()


def is_amino_acid(codon: Column) -> Column:
    return ~translate_codon(codon).isin("X", "*", "-", ".")


#: Starts of windows that one piece of a fuzzy search holds.
FUZZY_PIECE = 64


# Search -------------------------------------------------------------------------------------------------------------


def _found(at: Column, start: int = 0) -> Column:
    return F.when(at > 0, at - 1 + start)


def _range(at: Column, n: Column) -> Column:
    """The struct (start, end) of n characters from the 1-based place ``at``, null where it is 0."""
    return F.when(at > 0, F.struct((at - 1).cast("bigint").alias("start"), (at - 1 + n).cast("bigint").alias("end")))


def find_substring(col: Column, needle: str | Column) -> Column:
    """The first match; null for an empty needle or one that is longer."""
    n = _lit(needle)
    return F.when(F.length(n) > 0, _range(F.position(n, col), F.length(n)))


def contains_substring(col: Column, needle: str | Column) -> Column:
    return find_substring(col, needle).isNotNull()


def find_mapped(col: Column, needle: str, by: ByteMap) -> Column:
    """The first match in the mapped sequence."""
    return find_substring(by.apply(col), needle)


def find_fuzzy(col: Column, needle: str, k: int) -> Column:
    """The leftmost window with at most k substitutions.

    k + 1 parts of the needle cannot all be changed by k substitutions, so only pieces of the sequence that hold a part are
    looked at. Pieces are short (the needle's length and ``FUZZY_PIECE`` more), so the cost follows the sequence's length.
    """
    n = len(needle)
    if not n:
        return F.lit(None).cast("struct<start: bigint, end: bigint>")
    if k >= n:
        return F.when(F.length(col) >= n, _range(F.lit(1), F.lit(n)))
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    parts = [needle[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    size = FUZZY_PIECE
    windows = F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{1,{size + n - 1}}})).{{1,{size}}}"), F.lit(1))

    def differing(w: Column) -> Column:
        return sum((F.when(F.substr(w, F.lit(i + 1), F.lit(1)) != c, 1).otherwise(0) for i, c in enumerate(needle)), F.lit(0))

    def first(piece: Column, at: Column) -> Column:
        window = lambda s: F.substr(piece, s + 1, F.lit(n))
        fits = F.filter(F.sequence(F.lit(0), F.length(piece) - n), lambda s: (F.levenshtein(window(s), F.lit(needle), k) >= 0) & (differing(window(s)) <= k))
        some = F.lit(False)
        for p in parts:
            some = some | F.contains(piece, F.lit(p))
        return F.when((F.length(piece) >= n) & some, F.get(fits, F.lit(0)) + at * size)

    found = F.get(F.array_compact(F.transform(windows, first)), F.lit(0))
    return F.when(F.length(col) >= n, _range(F.coalesce(found + 1, F.lit(0)), F.lit(n)))


def _escaped(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def find_repeating(col: Column, byte: str, size: int) -> Column:
    """The first place where ``size`` copies of a character stand in a row."""
    return find_substring(col, byte * size) if size > 0 else F.lit(None).cast("struct<start: bigint, end: bigint>")


def find_repeating_at_start(col: Column, byte: str, least: int) -> Column:
    n = F.length(F.regexp_extract(col, f"^{char_class(byte)}*", 0))
    return F.when(n >= least, F.struct(F.lit(0).cast("bigint").alias("start"), n.cast("bigint").alias("end")))


def find_repeating_at_end(col: Column, byte: str, least: int) -> Column:
    n = F.length(F.regexp_extract(col, f"{char_class(byte)}*\\z", 0))
    return F.when(n >= least, F.struct((F.length(col) - n).cast("bigint").alias("start"), F.length(col).cast("bigint").alias("end")))


def find_byte(col: Column, any_of: str) -> Column:
    """The first place of any of the characters."""
    before = F.length(F.regexp_extract(col, f"^{char_class(any_of, negate=True)}*", 0))
    return F.when(before < F.length(col), before)


def position(col: Column, chars: str | None = None, *, pattern: str | None = None) -> Column:
    """The first place of a character of ``chars``, or of one that ``pattern`` (an expression of one character) matches."""
    if pattern is None:
        return find_byte(col, chars or "")
    before = F.length(F.regexp_extract(col, f"(?s)^(?:(?!{pattern}).)*", 0))
    return F.when(before < F.length(col), before)


def last_position(col: Column, chars: str | None = None, *, pattern: str | None = None) -> Column:
    """The last such place."""
    return F.length(col) - 1 - position(F.reverse(col), chars, pattern=pattern)


def find_last_byte(col: Column, any_of: str) -> Column:
    at = find_byte(F.reverse(col), any_of)
    return F.length(col) - 1 - at


def remove_first_substring(col: Column, needle: str) -> Column:
    """The sequence without the first match."""
    r = find_substring(col, needle)
    return F.when(r.isNull(), col).otherwise(F.concat(F.substring(col, F.lit(1), r["start"].cast("int")), F.substring(col, r["end"].cast("int") + 1, F.length(col))))


def search_in(col: Column, start: int, end: int, search) -> Column:
    """A search inside a range, in the coordinates of the whole; ``search`` gives a range for a column. Null unless the range exists."""
    return _shifted(search(slice_range(col, start, end)), F.lit(start))


def search_in_first(col: Column, n: int, search) -> Column:
    return search(F.substring(col, 1, n))


def search_in_last(col: Column, n: int, search) -> Column:
    begin = F.greatest(F.length(col) - n, F.lit(0))
    return _shifted(search(F.substring(col, begin + 1, F.lit(n))), begin)


def _shifted(r: Column, by: Column) -> Column:
    return F.when(r.isNotNull(), F.struct((r["start"] + by).cast("bigint").alias("start"), (r["end"] + by).cast("bigint").alias("end")))


def stepped_windows(col: Column, size: int, step: int) -> Column:
    """All full windows, left to right, by one pass; the shorter rest is ``final_partial_window``."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))


def final_partial_window(col: Column, size: int, step: int) -> Column:
    """What is left from the place where the next window would begin; null where nothing is."""
    last = F.length(col) - size
    begin = F.when(last >= 0, (F.floor(last / step).cast("int") + 1) * step).otherwise(F.lit(0))
    return F.nullif(F.substring(col, begin + 1, F.length(col)), F.lit(""))
