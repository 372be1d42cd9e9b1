"""Distances between aligned sequences, as native expressions.

Pairs are compared up to the shorter one's end. DNA distances leave out places where either base is not A, C, G, T or U,
and are null for empty input or where the formula has no finite value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Five factors of each residue; X and the gap are zero. Fixed values (Atchley et al. 2005, doi 10.1073/pnas.0408677102).
FACTORS = {
    "A": (-0.59, -1.3, -0.73, 1.57, -0.15),
    "C": (-1.34, 0.47, -0.86, -1.02, -0.26),
    "D": (1.05, 0.3, -3.66, -0.26, -3.24),
    "E": (1.36, -1.45, 1.48, 0.11, -0.84),
    "F": (-1.01, -0.59, 1.89, -0.4, 0.41),
    "G": (-0.38, 1.65, 1.33, 1.05, 2.06),
    "H": (0.34, -0.42, -1.67, -1.47, -0.08),
    "I": (-1.24, -0.55, 2.13, 0.39, 0.82),
    "K": (1.83, -0.56, 0.53, -0.28, 1.65),
    "L": (-1.02, -0.99, -1.51, 1.27, -0.91),
    "M": (-0.66, -1.52, 2.22, -1.01, 1.21),
    "N": (0.95, 0.83, 1.3, -0.17, 0.93),
    "P": (0.19, 2.08, -1.63, 0.42, -1.39),
    "Q": (0.93, -0.18, -3.01, -0.5, -1.85),
    "R": (1.54, -0.06, 1.5, 0.44, 2.9),
    "S": (-0.23, 1.4, -4.76, 0.67, -2.65),
    "T": (-0.03, 0.33, 2.21, 0.91, 1.31),
    "V": (-1.34, -0.28, -0.54, 1.24, -1.26),
    "W": (-0.6, 0.01, 0.67, -2.13, -0.18),
    "Y": (0.26, 0.83, 3.1, -0.84, 1.51),
    "X": (0.0, 0.0, 0.0, 0.0, 0.0),
    "-": (0.0, 0.0, 0.0, 0.0, 0.0),
}
BASES = "ACGT"


def _pairs(a: Column, b: Column, f) -> Column:
    """f over the letters of both up to the shorter one's end."""
    n = F.least(F.length(a), F.length(b))
    cut = lambda x: F.when(n > 0, F.split(F.substring(x, F.lit(1), n), "")).otherwise(F.array().cast("array<string>"))
    return F.zip_with(cut(a), cut(b), f)


def hamming(a: Column, b: Column) -> Column:
    """How many letters differ, cases and gaps included."""
    return F.size(F.filter(_pairs(a, b, lambda x, y: x != y), lambda d: d)).cast("bigint")


def substitution_matrix(a: Column, b: Column) -> Column:
    """Sixteen counts in an array: row by the second sequence's base, column by the first's, in the order ACGT.

    The pairs are written as one string of letters, so that counts are lengths.
    """
    pair = lambda x, y: F.concat(x, y)
    up = lambda x: F.translate(F.upper(x), "U", "T")
    codes = {x + y: chr(97 + 4 * BASES.index(y) + BASES.index(x)) for x in BASES for y in BASES}
    keys = F.array(*[F.lit(k) for k in sorted(codes, key=codes.get)])
    letters = F.lit("".join(sorted(codes.values())))
    coded = F.array_join(F.transform(_pairs(up(a), up(b), pair), lambda p: F.substr(letters, F.nullif(F.array_position(keys, p).cast("int"), F.lit(0)), F.lit(1))), "")
    # bound once, so that the pairs are written once and not for each cell
    counts = F.transform(F.array(coded), lambda z: F.array(*[(F.length(z) - F.length(F.replace(z, F.lit(c)))).cast("bigint") for c in sorted(codes.values())]))
    return F.element_at(counts, 1)


class Matrix:
    """The counts of a substitution matrix column, and the distances that follow from them."""

    def __init__(self, counts: Column) -> None:
        self.cell = [[counts[4 * r + c].cast("double") for c in range(4)] for r in range(4)]
        self.n = self._sum([x for row in self.cell for x in row])
        self.differing = self._sum([self.cell[r][c] for r in range(4) for c in range(4) if r != c])

    @staticmethod
    def _sum(x: list[Column]) -> Column:
        out = x[0]
        for v in x[1:]:
            out = out + v
        return out

    def share(self, *pairs: str) -> Column:
        """The share of the places with one of these base pairs, in either order."""
        cells = {(BASES.index(p[i]), BASES.index(p[1 - i])) for p in pairs for i in (0, 1)}
        return F.try_divide(self._sum([self.cell[r][c] for r, c in sorted(cells)]), self.n)

    def frequency(self, base: str) -> Column:
        i = BASES.index(base)
        return F.try_divide(self._sum([self.cell[i][k] for k in range(4)] + [self.cell[k][i] for k in range(4)]), self.n * 2)

    @staticmethod
    def log(x: Column) -> Column:
        return F.when(x > 0, F.ln(x))

    def hamming(self) -> Column:
        return self.differing.cast("bigint")

    def p_distance(self) -> Column:
        return F.try_divide(self.differing, self.n)

    def jc69(self) -> Column:
        return self.log(1 - self.p_distance() * F.lit(4.0) / 3) * F.lit(-0.75) + F.lit(0.0)

    def k80(self) -> Column:
        p, q = self.share("AG", "CT"), self.share("AC", "AT", "CG", "GT")
        return self.log(1 - 2 * p - q) * F.lit(-0.5) - self.log(1 - 2 * q) * F.lit(0.25) + F.lit(0.0)

    def k81(self) -> Column:
        p, q, r = self.share("AG", "CT"), self.share("AT", "CG"), self.share("AC", "GT")
        return self.log((1 - 2 * p - 2 * q) * (1 - 2 * p - 2 * r) * (1 - 2 * q - 2 * r)) * F.lit(-0.25) + F.lit(0.0)

    def f81(self) -> Column:
        e = F.lit(1.0) - self._sum([self.frequency(b) * self.frequency(b) for b in BASES])
        return -e * self.log(1 - F.try_divide(self.p_distance(), e)) + F.lit(0.0)

    def tn93(self) -> Column:
        a, c, g, t = (self.frequency(b) for b in BASES)
        r, y = a + g, c + t
        p1, p2, q = self.share("AG"), self.share("CT"), self.share("AC", "AT", "CG", "GT")
        d = F.try_divide
        k1, k2 = d(2 * a * g, r), d(2 * c * t, y)
        k3 = 2 * (r * y - d(a * g * y, r) - d(c * t * r, y))
        w1, w2, w3 = 1 - d(p1, k1) - d(q, 2 * r), 1 - d(p2, k2) - d(q, 2 * y), 1 - d(q, 2 * r * y)
        return -k1 * self.log(w1) - k2 * self.log(w2) - k3 * self.log(w3) + F.lit(0.0)


def p_distance_acgt(a: Column, b: Column) -> Column:
    return Matrix(substitution_matrix(a, b)).p_distance()


def physiochemical(a: Column, b: Column) -> Column:
    """(distance, error): the mean Euclidean distance of the residues' factors over places where both are known.

    Identical sequences have 0; ``NoData`` and ``NotComparable`` say why there is none. Distances are floats.
    """
    letters = "".join(FACTORS)
    table, names = [], list(FACTORS)
    for x in names:
        for y in names:
            table.append(0.0 if x == y else sum((u - v) ** 2 for u, v in zip(FACTORS[x], FACTORS[y], strict=True)) ** 0.5)
    distances = F.from_json(F.lit("[" + ",".join(map(repr, table)) + "]"), "array<double>")
    place = lambda x: F.position(F.upper(x), F.lit(letters))
    one = lambda x, y: F.when((place(x) > 0) & (place(y) > 0), F.element_at(distances, (place(x) - 1) * len(letters) + place(y)).cast("float"))
    known = F.array_compact(_pairs(a, b, one))
    # added one after another as floats
    total = F.aggregate(known, F.lit(0.0).cast("float"), lambda acc, v: (acc + v).cast("float"))
    mean = F.when(a == b, F.lit(0.0).cast("float")).otherwise(F.try_divide(total, F.size(known)).cast("float"))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    value = F.when(empty | (F.size(known) == 0), None).otherwise(mean)
    return F.struct(value.cast("float").alias("distance"), F.when(empty, "NoData").when(F.size(known) == 0, "NotComparable").alias("error"))
