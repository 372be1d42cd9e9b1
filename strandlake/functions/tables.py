"""Table functions for SQL text: ``register(spark)`` makes them known to a session.

Written in SQL, so that Catalyst plans a generator and no join, with ``LATERAL``:

- ``sequence_pieces(seq, k)``: (start, piece), 128 bases a piece and the first k - 1 of the next.
- ``kmers(seq, k, other)``: (pos, kmer); letters but ACGTU become ``other`` (N, or A for two bits). It makes one array of the
  row's k-mers, so long sequences are cut first: ``t, LATERAL sequence_pieces(t.seq, 21) p, LATERAL kmers(p.piece, 21, 'N') k``,
  with ``p.start + k.pos`` as the place.
- ``stepped_windows(seq, width, step)``: (pos, part), full windows only.
- ``ciglets(cigar)``: (place, inc, op) up to the first malformed place.

Over whole tables, in Arrow batches, with schemas that follow their arguments:

- ``site_counts(TABLE(t), 'key', 'seq', spread => 'id', parts => 16)``: (key, pos, eight counts). The function itself asks for
  a partition by key and by a hash of the column ``spread`` (by default the sequence; name one that copies of a sequence
  differ in), so a key of many rows is in as many tasks as there are parts; it reads these columns and no others. A task holds
  eight counts a site of its longest sequence. Counts are partial: sum them by key and pos.
- ``runs(TABLE(t) PARTITION BY ... ORDER BY (pos), 'pos', 'letter')``: letters at neighbouring positions joined to text, as
  (the other columns, start, text), at most a million letters a row. It holds one run, however large the partition is. Of
  rows at one position the first counts; rows without a position or a letter end a run. It takes rows one by one in Python;
  ``joined_runs`` does the same for a frame natively.

Nulls and empty texts give no rows. Names of columns are as in the table, apart from upper and lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from strandlake.functions.composition import SLOTS
from strandlake.operators.kmers import PIECE
from strandlake.operators.sites import _SLOT
from strandlake.shipping import ship

_CUT = f"regexp_extract_all(seq, '(?s).{{1,{PIECE}}}', 0)"
_SQL = {
    "sequence_pieces": (
        "seq string, k int",
        "start bigint, piece string",
        f"inline(transform(zip_with({_CUT}, slice({_CUT}, 2, greatest(size({_CUT}) - 1, 0)), (a, b) -> concat(a, coalesce(left(b, k - 1), ''))), (p, i) -> named_struct('start', {PIECE}L * i, 'piece', p)))",
    ),
    "kmers": (
        "seq string, k int, other string",
        "pos bigint, kmer string",
        # the letters are mapped once, not again in each k-mer; the lambda over one element binds them
        "inline(flatten(transform(array(regexp_replace(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]', other)), s -> transform(if(length(seq) >= k and k > 0, sequence(0, length(seq) - k), array()), i -> named_struct('pos', cast(i as bigint), 'kmer', substr(s, i + 1, k))))))",
    ),
    "stepped_windows": (
        "seq string, width int, step int",
        "pos bigint, part string",
        "inline(transform(if(length(seq) >= width and width > 0 and step > 0, sequence(0, length(seq) - width, step), array()), i -> named_struct('pos', cast(i as bigint), 'part', substr(seq, i + 1, width))))",
    ),
    "ciglets": (
        "cigar string",
        "place int, inc bigint, op string",
        "inline(transform(regexp_extract_all(cigar, '\\\\G[0-9]+[MIDNSHP=X]', 0), (p, i) -> named_struct('place', i, 'inc', try_cast(left(p, length(p) - 1) as bigint), 'op', right(p, 1))))",
    ),
}

#: Letters of a run.
RUN = 1_000_000


def _column(table: AnalyzeArgument, name: AnalyzeArgument, what: str) -> StructField:
    """The table's column that an argument names."""
    if not table.isTable:
        raise ValueError("the first argument is TABLE(...)")
    if not name.isConstantExpression or not isinstance(name.value, str):
        raise ValueError(f"{what} is a column's name, as a constant")
    found = [f for f in table.dataType.fields if f.name.lower() == name.value.lower()]
    if len(found) != 1:
        raise ValueError(f"the table has {len(found)} columns called {name.value}")
    return found[0]


def _text(field: StructField) -> StructField:
    if not isinstance(field.dataType, StringType):
        raise ValueError(f"{field.name} is no text")
    return field


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class SiteCounts:
    """Partial counts of the letters of each site of a key's sequences."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, seq: AnalyzeArgument, spread: AnalyzeArgument | None = None, parts: AnalyzeArgument | None = None) -> AnalyzeResult:
        k, s = _column(table, key, "key"), _text(_column(table, seq, "seq"))
        if k.name.lower() in {"pos", *SLOTS}:
            raise ValueError(f"a key called {k.name} clashes with a column of the result")
        n = 16 if parts is None else parts.value
        if not isinstance(n, int) or n < 1:
            raise ValueError("parts is a number from 1 on")
        schema = StructType([StructField(k.name, k.dataType), StructField("pos", LongType()), *[StructField(x, LongType()) for x in SLOTS]])
        by = s if spread is None else _column(table, spread, "spread")
        split = f"pmod(xxhash64({_quoted(by.name)}), {n})"
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(_quoted(k.name)), PartitioningColumn(split)], select=[SelectedColumn(_quoted(k.name), "key"), SelectedColumn(_quoted(s.name), "seq")])

    def __init__(self) -> None:
        self.key, self.counts = None, np.zeros((0, len(SLOTS)), np.int64)

    def eval(self, table: Row, key: str, seq: str, spread: str = "", parts: int = 16) -> Iterator[tuple]:
        self.key, text = table["key"], table["seq"]
        if not text:
            return
        slots = _SLOT[np.frombuffer(text.encode(), np.uint8)]
        if len(slots) > len(self.counts):
            wider = np.zeros((max(len(slots), 2 * len(self.counts)), len(SLOTS)), np.int64)
            wider[: len(self.counts)] = self.counts
            self.counts = wider
        self.counts[np.arange(len(slots)), slots] += 1
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        for pos in np.flatnonzero(self.counts.any(axis=1)).tolist():
            yield (self.key, pos, *self.counts[pos].tolist())


class Runs:
    """Letters in the order of their positions, joined where these are neighbours."""

    @staticmethod
    def analyze(table: AnalyzeArgument, pos: AnalyzeArgument, letter: AnalyzeArgument) -> AnalyzeResult:
        p, s = _column(table, pos, "pos"), _text(_column(table, letter, "letter"))
        if p.dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"{p.name} is no whole number")
        others = [f for f in table.dataType.fields if f.name not in (p.name, s.name)]
        if {f.name.lower() for f in others} & {"start", "text"}:
            raise ValueError("the table's other columns can't be called start or text")
        return AnalyzeResult(StructType([*others, StructField("start", LongType()), StructField("text", StringType())]))

    def __init__(self) -> None:
        self.kept, self.start, self.next, self.letters, self.size = (), 0, None, [], 0

    def _run(self) -> Iterator[tuple]:
        if self.letters:
            yield (*self.kept, self.start, "".join(self.letters))
        self.next, self.letters, self.size = None, [], 0

    def eval(self, table: Row, pos: str, letter: str) -> Iterator[tuple]:
        names = {n.lower(): i for i, n in enumerate(table.__fields__)}
        at, x = names[pos.lower()], names[letter.lower()]
        place, text = table[at], table[x]
        if place is None or not text:
            yield from self._run()
            return
        if self.next is not None and place == self.next - 1:  # a position again
            return
        if place != self.next or self.size >= RUN:
            yield from self._run()
            self.start, self.kept = place, tuple(v for i, v in enumerate(table) if i not in (at, x))
        self.letters.append(text)
        self.size += len(text)
        self.next = place + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._run()


def joined_runs(df: DataFrame, pos: str, letter: str, *by: str) -> DataFrame:
    """The rows of ``runs`` over a frame, (the columns by, start, text), by windows and aggregations alone: no row passes through Python.

    Rows without a position or a letter leave a gap; of several letters at a position the least counts. A row of text has at
    most ``RUN`` positions.
    """
    keys = [F.col(c) for c in by]
    at, x = F.col(pos).cast("bigint").alias("_at"), F.col(letter).alias("_x")
    placed = df.where(F.col(pos).isNotNull() & (F.col(letter) != "")).select(*keys, at, x).repartition(*keys)  # one shuffle serves all steps
    one = placed.groupBy(*keys, "_at").agg(F.min("_x").alias("_x"))
    island = F.col("_at") - F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    rows = one.withColumn("_island", island)
    rows = rows.withColumn("_part", F.floor((F.col("_at") - F.min("_at").over(Window.partitionBy(*keys, "_island").orderBy("_at"))) / RUN))
    joined = rows.groupBy(*keys, "_island", "_part").agg(F.min("_at").alias("start"), F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    return joined.select(*keys, "start", F.array_join(F.col("_all._x"), "").alias("text"))


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, under the names above; functions of these names are replaced."""
    from pyspark.sql.functions import udtf

    ship(spark)
    for name, (takes, gives, body) in _SQL.items():
        spark.sql(f"create or replace temporary function {name}({takes}) returns table ({gives}) return select {body}")
    spark.udtf.register("site_counts", udtf(SiteCounts, useArrow=True))
    spark.udtf.register("runs", udtf(Runs, useArrow=True))
