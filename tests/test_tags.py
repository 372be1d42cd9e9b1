"""Optional SAM fields: typed lookups against a plain reading, malformed fields, and printing back."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.operators import tags as tg

RAW = "o array<string>"
ALL = ["AS:i:-5", "NM:i:+7", "XA:A::", "XF:f:1.5", "XZ:Z:a:b", "XE:Z:", "XH:H:0aFf", "XN:H:", "BC:B:c,-128,127", "BD:B:C,+255,0", "BS:B:s,-32768", "BT:B:S,65535", "BI:B:i,-2147483648", "BU:B:I,4294967295", "BF:B:f,1e2,.5,inf", "BE:B:c", "AS:i:9"]
BAD = ["XA:A:", "XA:A:ab", "XA:A:\u00e9", "XA:i:", "XA:i:5.0", "XA:i: 5", "XA:i:+", "XA:i:9223372036854775808", "XA:f:1d", "XA:f:", "XA:f:0x1p3", "XA:H:abc", "XA:H:0g", "XA:B:", "XA:B:x,1", "XA:B:c,128", "XA:B:C,-0", "XA:B:S,65536", "XA:B:i,", "XA:B:f,1,x", "XA:q:1", "XA:ii:5", "XA::5", "XA:i", "XA:"]


def one(spark, fields):
    return spark.createDataFrame([(fields,)], RAW).select(tg.parsed(F.col("o")).alias("v"))


def test_lookups_of_every_type(spark):
    v = F.col("v")
    got = one(spark, ALL).select(
        tg.integer(v, "AS"), tg.integer(v, "NM"), tg.char(v, "XA"), tg.real(v, "XF"), tg.string(v, "XZ"), tg.string(v, "XE"), tg.hexadecimal(v, "XH"), tg.hexadecimal(v, "XN"),
        *[tg.items(v, t) for t in ("BC", "BD", "BS", "BT", "BI", "BU", "BE")], tg.items(v, "BF", "float"), tg.items(v, "BF"), tg.subtype(v, "BU"), tg.type_of(v, "BU"), tg.integer(v, "XF"), tg.char(v, "XZ"), tg.type_of(v, "QQ"), tg.integer(v, "QQ"),
    ).first()
    assert list(got) == [-5, 7, ":", 1.5, "a:b", "", "0AFF", "", [-128, 127], [255, 0], [-32768], [65535], [-(1 << 31)], [(1 << 32) - 1], [], [100.0, 0.5, math.inf], None, "I", "B", None, None, None, None]


def test_malformed_fields(spark):
    v = F.col("v")
    every = spark.createDataFrame([(["NM:i:1", bad, "AS:i:5"],) for bad in BAD], RAW).select("o", tg.parsed(F.col("o")).alias("v"))
    for r in every.select("o", tg.integer(v, "AS").alias("a"), tg.fault(v, "XA").alias("f"), tg.type_of(v, "XA", strict=False).alias("t")).collect():
        assert r["a"] == 5 and r["f"] and r["t"] is None, r["o"]  # its colon tells that it is another tag
    with pytest.raises(Exception, match="SAM field XA"):
        every.select(tg.type_of(v, "XA")).collect()
    for fields in (["bad", "AS:i:5"], [None, "AS:i:5"], ["", "AS:i:5"]):
        with pytest.raises(Exception, match="without a colon"):
            one(spark, fields).select(tg.integer(v, "AS")).collect()
    df = one(spark, ["AS:i:5", "bad"])
    assert df.select(tg.integer(v, "AS")).first()[0] == 5
    with pytest.raises(Exception, match="without a colon"):
        df.select(tg.integer(v, "NM")).collect()
    assert df.select(tg.fault(v, "NM"), tg.fault(v, "AS")).first()[1] is None
    assert one(spark, None).select(v.isNull(), tg.integer(v, "AS")).first()[:] == (True, None)
    assert one(spark, []).select(v.isNull(), tg.integer(v, "AS")).first()[:] == (False, None)
    with pytest.raises(ValueError):
        tg.integer(v, "A:")


def test_rows_by_mode(spark):
    df = spark.createDataFrame([(1, ["AS:i:5", "bad", "XA:A:"], "m"), (2, None, "n"), (3, [], "n")], "id int, o array<string>, _member string")
    got = tg.rows(df, "o", ("id", "_member"), "PERMISSIVE").select("id", "at", "tag", F.expr("cast(value as string)").alias("value"), "_corrupt_record", "_member").orderBy("at").collect()
    assert [tuple(r) for r in got] == [(1, 0, "AS", "5", None, "m"), (1, 1, "bad", None, "no colon", "m"), (1, 2, "XA", None, "malformed value of type A", "m")]
    assert tg.rows(df, "o", ("id",), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed SAM field"):
        tg.rows(df, "o").count()
    assert tg.rows(df.limit(0), "o").count() == 0


def test_printing(spark):
    c = F.col
    df = spark.createDataFrame([("x", 5, 1.5, "t:u", "0aFf", [1, 255], None)], "a string, i int, f float, z string, h string, b array<int>, o array<string>")
    out = c("o")
    for tag, shown in (("XA", tg.show_char(c("a"))), ("AS", tg.show_integer(c("i"))), ("XF", tg.show_real(c("f"))), ("XZ", tg.show_string(c("z"))), ("XH", tg.show_hexadecimal(c("h"))), ("XB", tg.show_items(c("b"), "C")), ("XE", tg.show_items(F.array().cast("array<int>"), "s")), ("XN", tg.show_string(F.lit(None).cast("string")))):
        out = tg.push(out, tag, shown)
    assert df.select(out).first()[0] == ["XA:A:x", "AS:i:5", "XF:f:1.5", "XZ:Z:t:u", "XH:H:0AFF", "XB:B:C,1,255", "XE:B:s"]
    for shown in (tg.show_items(c("b"), "c"), tg.show_char(c("z")), tg.show_hexadecimal(c("a")), tg.show_items(F.array(F.lit(None).cast("int")), "i")):
        with pytest.raises(Exception, match="field|item"):
            df.select(shown).collect()


def test_float_text_reads_back(spark):
    rnd = random.Random(5)
    fixed = [(0.0, "0"), (-0.0, "-0"), (1.0, "1"), (-1.5, "-1.5"), (1e10, "10000000000"), (1.5e-5, "0.000015"), (0.001, "0.001"), (123.456, "123.456"), (math.inf, "inf"), (-math.inf, "-inf"), (16777216.0, "16777216"), (1.25e8, "125000000")]
    made = [struct.unpack("f", rnd.randbytes(4))[0] for _ in range(500)]
    rows = [(float(x),) for x in [*(x for x, _ in fixed), *made] if x == x]
    got = spark.createDataFrame(rows, "x double").select(F.col("x").cast("float").alias("x")).select("x", tg.shown_float(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got[: len(fixed)]] == [t for _, t in fixed]
    for r in got:
        assert "e" not in r["t"].lower() and struct.pack("f", float(r["t"])) == struct.pack("f", r["x"])


def test_fields_are_read_outside_of_lambdas(spark):
    """Rows are cut before they are judged, and lookups judge only the field that they find, with the same faults."""
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate([*ALL, *BAD])], "id int, o array<string>")
    rows = tg.rows(df, "o", ("id",), "PERMISSIVE")
    v = F.col("v")
    looked = df.select("id", tg.parsed(F.col("o")).alias("v"))
    faults = looked.select("id", F.coalesce(*[tg.fault(v, t) for t in dict.fromkeys(x[:2] for x in ALL)]).alias("fault"))
    assert {r["id"]: r["_corrupt_record"] for r in rows.collect()} == {r["id"]: r["fault"] for r in faults.collect()}
    inside = df.select("id", F.explode(tg.members(F.col("o"))).alias("m")).select("id", "m.tag", "m.type", F.expr("cast(m.value as string)"), "m.fault")
    assert sorted(inside.collect(), key=str) == sorted(rows.select("id", "tag", "type", F.expr("cast(value as string)"), "_corrupt_record").collect(), key=str)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(transform" not in plan(rows)
    assert "variant" not in plan(looked.select(tg.integer(v, "AS"))).lower()
