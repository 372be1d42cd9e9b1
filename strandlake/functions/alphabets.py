"""Alphabets and byte tables, and how they become native column expressions.

Sequences are ASCII strings; other characters count as one unknown character each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IUPAC = "ACGTURYSWKMBDHVN"
ACGTN = "ACGTN"
ACGT = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AMINO_ACIDS_X = AMINO_ACIDS + "X"
PROFILE_RESIDUES = "ACDEFGHIKLMNPQRSTVWY*BJZX"
COMPLEMENT = ("GCATRYKMBVDHU", "CGTAYRMKVBHDA")
#: The bases that each letter may stand for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: The standard genetic code, codons in the order of TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def both_cases(letters: str) -> str:
    return letters + letters.lower()


def char_class(chars: str, negate: bool = False) -> str:
    """A regular expression's class of these characters, the same in Java and RE2."""
    return "[" + "^" * negate + "".join("\\" + c if c in "\\]^-[&" else c for c in dict.fromkeys(chars)) + "]"


@dataclass(frozen=True)
class Validator:
    """A set of characters, built by adding and removing."""

    chars: frozenset[str] = frozenset()

    def add(self, chars: str) -> Validator:
        return Validator(self.chars | set(chars))

    def remove(self, chars: str) -> Validator:
        return Validator(self.chars - set(chars))

    def add_range(self, first: str, last: str) -> Validator:
        return self.add("".join(map(chr, range(ord(first), ord(last) + 1))))

    def remove_range(self, first: str, last: str) -> Validator:
        return self.remove("".join(map(chr, range(ord(first), ord(last) + 1))))

    @staticmethod
    def all() -> Validator:
        return Validator(frozenset(map(chr, range(128))))

    @property
    def text(self) -> str:
        return "".join(sorted(self.chars))

    def is_valid(self, col: Column) -> Column:
        """Whether all characters are in the set (true for an empty sequence)."""
        return F.length(self.drop(col)) == 0 if self.chars else F.length(col) == 0

    def drop(self, col: Column) -> Column:
        return F.regexp_replace(col, f"{char_class(self.text)}+", "") if self.chars else col

    def retain(self, col: Column) -> Column:
        """Only the characters of the set, in their case."""
        return F.regexp_replace(col, f"{char_class(self.text, negate=True)}+", "") if self.chars else F.lit("")


@dataclass(frozen=True)
class ByteMap:
    """A map of characters; unmapped ones stay (default None), become the default, or go (default "")."""

    default: str | None = None
    pairs: dict[str, str] = field(default_factory=dict)

    def map(self, from_: str, to: str) -> ByteMap:
        if len(from_) != len(to):
            raise ValueError("both sides need the same number of characters")
        return ByteMap(self.default, self.pairs | dict(zip(from_, to, strict=True)))

    def map_to_one(self, from_: str, to: str) -> ByteMap:
        return ByteMap(self.default, self.pairs | dict.fromkeys(from_, to))

    def preserve(self, chars: str) -> ByteMap:
        return self.map(chars, chars)

    def map_range(self, first: str, last: str, start: str) -> ByteMap:
        n = ord(last) - ord(first) + 1
        return self.map("".join(chr(ord(first) + i) for i in range(n)), "".join(chr(ord(start) + i) for i in range(n)))

    def map_range_to_one(self, first: str, last: str, to: str) -> ByteMap:
        """All characters from first to last become one; none if last comes before first."""
        return self.map_to_one("".join(map(chr, range(ord(first), ord(last) + 1))), to)

    def preserve_range(self, first: str, last: str) -> ByteMap:
        return self.map_range(first, last, first)

    def apply(self, col: Column) -> Column:
        out = col
        if self.default is not None:
            keys = "".join(sorted(self.pairs))
            out = F.regexp_replace(out, char_class(keys, negate=True), self.default) if keys else F.regexp_replace(out, "(?s).", self.default)
        moved = {k: v for k, v in self.pairs.items() if k != v and not (self.default is not None and k == self.default)}
        kept, gone = {k: v for k, v in moved.items() if v}, [k for k, v in moved.items() if not v]
        keys = [*kept, *gone]
        return F.translate(out, "".join(keys), "".join(kept.values())) if keys else out

    def of(self, text: str) -> str:
        """The same for a Python string."""
        return "".join(self.pairs.get(c, c if self.default is None else self.default) for c in text)


def _uppered(letters: str, default: str | None) -> ByteMap:
    return ByteMap(default).preserve(letters).map(letters.lower(), letters).map("Uu", "TT")


_AMBIGUOUS = "RYSWKMBDHVN"
VALID = {
    "iupac_no_gaps": Validator().add(both_cases(IUPAC)),
    "iupac_no_gaps_uc": Validator().add(IUPAC),
    "iupac_with_gaps": Validator().add(both_cases(IUPAC) + "-."),
    "iupac_with_gaps_uc": Validator().add(IUPAC + "-."),
    "acgtn_no_gaps": Validator().add(both_cases(ACGTN)),
    "acgtn_no_gaps_uc": Validator().add(ACGTN),
    "acgtn_std_gaps_uc": Validator().add(ACGTN + "-"),
    "acgt_no_gaps": Validator().add(both_cases(ACGT)),
    "acgt_no_gaps_uc": Validator().add(ACGT),
}
REFINE = {
    "iupac_no_gaps_uc": _uppered(IUPAC, ""),
    "iupac_with_gaps_uc": _uppered(IUPAC, "").preserve(".-"),
    "iupac_correct_gaps_uc": _uppered(IUPAC, "").preserve(".-").map_to_one(":~", "-"),
    "acgtn_no_gaps_uc": _uppered(ACGTN, ""),
    "acgtn_with_gaps_uc": _uppered(ACGTN, "").preserve(".-"),
    "acgtn_std_gaps_uc": _uppered(ACGTN, "").map_to_one(".-:~", "-"),
    "acgt_no_gaps_uc": _uppered(ACGT, ""),
}
RECODE = {
    "iupac_to_acgtn_with_gaps": ByteMap().map("Uu", "Tt").map_to_one(_AMBIGUOUS, "N").map_to_one(_AMBIGUOUS.lower(), "n"),
    "iupac_to_acgtn_with_gaps_upper": ByteMap().map(IUPAC.lower(), IUPAC).map("Uu", "TT").map_to_one(both_cases(_AMBIGUOUS), "N"),
    "any_to_acgtn_no_gaps_upper": _uppered(ACGTN, "N"),
    "any_to_acgtn_with_gaps_upper": _uppered(ACGTN, "N").preserve(".-"),
    "any_to_iupac_with_gaps": ByteMap("N").preserve(both_cases(IUPAC)).map("Uu", "Tt").preserve(".-"),
    "any_to_iupac_with_gaps_upper": _uppered(IUPAC, "N").preserve(".-"),
    "any_to_iupac_correct_gaps_upper": _uppered(IUPAC, "N").preserve(".-").map(":~", "--"),
    "to_rna": ByteMap("N").preserve(both_cases("ACGUN")).map("Tt", "Uu"),
    "to_rna_upper": ByteMap("N").map("ACGUT", "ACGUU").map("acgut", "ACGUU"),
    "any_to_acgtn_no_gaps": ByteMap("N").preserve(both_cases(ACGTN)).map("Uu", "Tt"),
    "any_to_acgtn_with_gaps": ByteMap("N").preserve(both_cases(ACGTN)).map("Uu", "Tt").preserve(".-"),
    "any_to_iupac_no_gaps": ByteMap("N").preserve(both_cases(IUPAC)).map("Uu", "Tt"),
    "any_to_iupac_no_gaps_upper": _uppered(IUPAC, "N"),
}
#: Encodings of bases for k-mers: three bits with N as the rest, two bits with A as the rest.
KMER3, KMER2 = _uppered(ACGTN, "N"), _uppered(ACGT, "A")


def genetic_code() -> dict[str, str]:
    """Codons in upper case, DNA and RNA, whose every reading gives one residue, and those of gaps and NNN."""
    order = "TCAG"
    plain = {a + b + c: CODE[16 * i + 4 * j + k] for (i, a), (j, b), (k, c) in product(enumerate(order), repeat=3)}
    out = {}
    letters = [x for x in AMBIGUITY if x != "U"]
    for codon in map("".join, product(letters, repeat=3)):
        if len(found := {plain["".join(x)] for x in product(*(AMBIGUITY[c] for c in codon))}) == 1:
            out[codon] = found.pop()
    out |= {k.replace("T", "U"): v for k, v in out.items()}
    return out | {"NNN": "X", "---": "-"} | {"".join(x): "." for x in product(".-", repeat=3) if "." in x}




@dataclass(frozen=True)
class ByteIndex:
    """Places of characters in an alphabet; unknown ones have that of ``rest``."""

    alphabet: str
    rest: str
    ignore_case: bool = True
    synonyms: tuple[tuple[str, str], ...] = ()

    def add_synonym(self, new: str, old: str) -> ByteIndex:
        return ByteIndex(self.alphabet, self.rest, self.ignore_case, (*self.synonyms, (new, old)))

    def _mapped(self, col: Column) -> Column:
        out = F.upper(col) if self.ignore_case else col
        return F.translate(out, "".join(a for a, _ in self.synonyms), "".join(b for _, b in self.synonyms)) if self.synonyms else out

    def to_index(self, col: Column) -> Column:
        """The place of a one-letter column, from 0."""
        at = F.position(self._mapped(col), F.lit(self.alphabet))
        return F.when(at > 0, at - 1).otherwise(self.alphabet.index(self.rest))

    def in_keys(self, col: Column) -> Column:
        return F.position(self._mapped(col), F.lit(self.alphabet)) > 0

    def counts(self, col: Column) -> Column:
        """How often each letter of the alphabet stands in a sequence, the rest counted with its letter."""
        known = char_class(self.alphabet, negate=True)
        text = F.regexp_replace(self._mapped(col), known, self.rest)
        return F.array(*[F.length(F.regexp_replace(text, f"{char_class(c, negate=True)}+", "")).cast("bigint") for c in self.alphabet])


DNA_PROFILE = ByteIndex(ACGTN, "N", synonyms=(("U", "T"),))
DNA_UNAMBIGUOUS_PROFILE = ByteIndex(ACGT, "A", synonyms=(("U", "T"),))
AA_PROFILE = ByteIndex(AMINO_ACIDS_X, "X")
AA_UNAMBIGUOUS_PROFILE = ByteIndex(AMINO_ACIDS, "A")
AA_ALL_PROFILE = ByteIndex(PROFILE_RESIDUES, "X")
