"""SAM records: optional fields, conversion and coordinate sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg

HEADER = "@HD\tVN:1.6\tSO:coordinate"
#: Parts of a sorted table for each split of its input.
SORTED_PARTS = 8
FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def is_unmapped(flag: Column, cigar: Column) -> Column:
    return (flag.bitwiseAND(4) != 0) | (cg.ref_len(cigar) == 0)


def is_missing(col: Column) -> Column:
    return col.isin("", "*")


def unmapped(qname: Column, rname: Column) -> list[Column]:
    """The columns of an unmapped record."""
    values = (qname, F.lit(4), rname, F.lit(0).cast("bigint"), F.lit(255).cast("smallint"), F.lit(""), F.lit("*"), F.lit(0).cast("bigint"), F.lit(0), F.lit("*"), F.lit("*"))
    return [v.alias(k) for k, v in zip(FIELDS, values, strict=True)]


def optional(fields: Column, tag: str) -> Column:
    """The first field with this tag, as (type, value); null if there is none."""
    found = F.filter(fields, lambda x: F.startswith(x, F.lit(tag + ":")))
    return F.get(F.transform(found, lambda x: F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value"))), F.lit(0))


def typed(field: Column) -> Column:
    """A field (type, value) as (type, char, int, float, string, subtype, arr); null members where it is of another type."""
    return F.get(F.transform(F.array(field), _typed), F.lit(0))  # the field is looked for once


def _typed(field: Column) -> Column:
    t, v = field["type"], field["value"]
    parts = F.split(v, ",")
    arr = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return F.when(field.isNotNull(), F.struct(t.alias("type"), F.when((t == "A") & (F.length(v) == 1), v).alias("char"), F.when(t == "i", v.try_cast("bigint")).alias("int"), F.when(t == "f", v.try_cast("float")).alias("float"), F.when(t == "Z", v).when((t == "H") & v.rlike(r"^([0-9A-Fa-f]{2})*\z"), F.upper(v)).alias("string"), F.when((t == "B") & F.get(parts, F.lit(0)).rlike(r"^[cCsSiIf]\z"), F.get(parts, F.lit(0))).alias("subtype"), F.when(t == "B", arr).alias("arr")))


def from_alignment(alignment: Column, qname: Column, rname: Column, seq: Column, qual: Column, mapq: int = 255, flag: int = 0) -> Column:
    """The record of an alignment struct, with its score as AS:i."""
    values = (qname, F.lit(flag), rname, alignment["ref_start"] + 1, F.lit(mapq).cast("smallint"), alignment["cigar"], F.lit("*"), F.lit(0).cast("bigint"), F.lit(0), seq, qual)
    return F.struct(*[v.alias(k) for k, v in zip(FIELDS, values, strict=True)], F.array(F.concat(F.lit("AS:i:"), alignment["score"].cast("string"))).alias("opt_fields"))


def to_alignment(flag: Column, pos: Column, cigar: Column, seq: Column, score: Column, ref_len: Column) -> Column:
    """The alignment of a record: status Unmapped, or its ranges with clips taken off both sides."""
    lead = F.aggregate(cg.ciglets(F.regexp_extract(cigar, r"^(?:[0-9]+H)?((?:[0-9]+S)?)", 1)), F.lit(0).cast("bigint"), lambda a, c: a + c["inc"])
    trail = F.aggregate(cg.ciglets(F.regexp_extract(cigar, r"((?:[0-9]+S)?)(?:[0-9]+H)?\z", 1)), F.lit(0).cast("bigint"), lambda a, c: a + c["inc"])
    n = F.length(seq).cast("bigint")
    gone = is_unmapped(flag, cigar)
    of = lambda x: F.when(~gone, x)
    return F.struct(F.when(gone, "Unmapped").otherwise("Some").alias("status"), of(score).alias("score"), of(pos - 1).alias("ref_start"), of(pos - 1 + cg.ref_len(cigar)).alias("ref_end"), of(lead).alias("query_start"), of(n - trail).alias("query_end"), of(cigar).alias("cigar"), of(ref_len).alias("ref_len"), of(n).alias("query_len"))


def coordinate_sort(records: DataFrame, references: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Records by reference, position and name; equal ones stay in the order of the input.

    references: (rname, idx), the order of the header's sequences. Known references come in the header's order; unknown ones
    are one class after them; ``*`` is last. The table of references is small by nature (a header) and is joined; Spark
    broadcasts it below its threshold. ordinal: a column that orders the input (``read_sam`` makes one of files); without
    it the order is that of the frame's partitions and of the rows in them.
    """
    taken = {c.lower() for c in records.columns}
    idx, place, name = (next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("idx", "place", "reference"))
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    joined = records.withColumn(place, order).join(references.select(F.col("rname").alias(name), F.col("idx").alias(idx)), F.col("rname") == F.col(name), "left")
    kind = F.when(F.col("rname") == "*", 2).when(F.col(idx).isNull(), 1).otherwise(0)
    keys = [kind, F.coalesce(idx, F.lit(0)), F.col("pos"), F.col("qname"), F.col(place)]
    # parts follow the input's splits, so that no task's part grows with the input; in their order they are the sorted table
    conf = records.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = max(int(conf), SORTED_PARTS * records.rdd.getNumPartitions())
    return joined.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*records.columns)
