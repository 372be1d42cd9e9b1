"""Table functions called from SQL text, against plain versions."""

import random
from collections import Counter

import pytest

from strandlake.functions import tables
from strandlake.functions.composition import SLOTS
from tests.test_sites import bases, literal


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    tables.register(spark)  # again does no harm

    def run(text, **frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).repartition(3).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def test_kmers_and_windows(sql):
    rnd = random.Random(1)
    rows = [(i, s) for i, s in enumerate([None, "", "AC", "acgu", "AC-GN", *(bases(rnd, n, "ACGTUacgtN-") for n in (127, 128, 129, 130, 257, 1000))])]
    norm = str.maketrans("acgtuUN-", "ACGTTTNN")
    expected = Counter((i, j, s[j : j + 3].translate(norm)) for i, s in rows for j in range(len(s or "") - 2))
    direct = sql("select id, k.pos, k.kmer from t, lateral kmers(t.seq, 3, 'N') k", t=(rows, "id int, seq string"))
    assert Counter(tuple(r) for r in direct.collect()) == expected
    cut = sql("select id, p.start + k.pos as pos, k.kmer from t, lateral sequence_pieces(t.seq, 3) p, lateral kmers(p.piece, 3, 'N') k")
    assert Counter(tuple(r) for r in cut.collect()) == expected
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in ("Join", "Aggregate", "Python") if x in plan], plan
    for width, step in ((3, 1), (3, 3), (2, 5), (200, 7)):
        got = sql(f"select id, w.pos, w.part from t, lateral stepped_windows(t.seq, {width}, {step}) w").collect()
        assert Counter(tuple(r) for r in got) == Counter((i, j, s[j : j + width]) for i, s in rows for j in range(0, len(s or "") - width + 1, step))


def test_ciglets(sql):
    rows = [(1, "3S10M2I4="), (2, "5M?3M"), (3, ""), (4, None), (5, "M"), (6, "99999999999999999999M1X")]
    got = sql("select id, c.place, c.inc, c.op from c, lateral ciglets(c.cigar) c order by id, place", c=(rows, "id int, cigar string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, "S"), (1, 1, 10, "M"), (1, 2, 2, "I"), (1, 3, 4, "="), (2, 0, 5, "M"), (6, 0, None, "M"), (6, 1, 1, "X")]


def test_site_counts(sql):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), bases(rnd, rnd.randint(0, 40)), i) for i in range(200)] + [("a", None, 0), ("c", "", 0), ("d", bases(rnd, 3000), 0)]
    sums = ", ".join(f"sum({s}) as {s}" for s in SLOTS)
    for parts in ("", ", parts => 1", ", spread => 'pos', parts => 64"):
        got = sql(f"select `Key`, pos, {sums} from site_counts(table(s), key => 'key', seq => 'SEQ'{parts}) group by all", s=(rows, "Key string, seq string, pos int")).collect()
        assert {(r[0], r["pos"], s): r[s] for r in got for s in SLOTS if r[s]} == dict(literal((k, s) for k, s, _ in rows))
    assert sql("select * from site_counts(table(select * from s where false), 'key', 'seq')").count() == 0
    for bad in ("'none', 'seq'", "'key', 'pos'", "'pos', 'seq'", "'key', 'seq', 'pos', 0"):
        with pytest.raises(Exception, match="columns called|no text|clashes|from 1 on"):
            sql(f"select * from site_counts(table(s), {bad})").collect()


def test_runs(sql):
    rows = [("x", 1, "A", 7), ("x", 2, "C", 7), ("x", 2, "C", 7), ("x", 4, "G", 7), ("x", 5, None, 7), ("x", 6, "T", 7), ("y", 3, "A", 8), (None, 9, "N", 9), ("x", None, "Z", 7)]
    got = sql("select * from runs(table(r) partition by k order by (p), 'P', 'c')", r=(rows, "k string, p int, c string, other int"))
    assert got.columns == ["k", "other", "start", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("x", 7, 1, "AC"), ("x", 7, 4, "G"), ("x", 7, 6, "T"), ("y", 8, 3, "A"), (None, 9, 9, "N")], key=str)
    with pytest.raises(Exception, match="start or text"):
        sql("select * from runs(table(select k as text, p, c from r) partition by text order by (p), 'p', 'c')").collect()


def test_map_ranges(spark):
    from pyspark.sql import functions as F

    from strandlake.functions.alphabets import ByteMap

    one = ByteMap("_").preserve_range("0", "9").map_range_to_one("a", "c", "!").map_range_to_one("b", "a", "?").map("c", "d")
    row = spark.createDataFrame([("09abcd x\n", "")], "s string, e string").select(one.apply(F.col("s")), one.apply(F.col("e")), ByteMap().map_range_to_one("a", "c", "").apply(F.col("s"))).first()
    assert list(row) == ["09!!d____", "", "09d x\n"]


def test_joined_runs(spark, sql, monkeypatch):
    rows = [("x", 1, "A", 7), ("x", 2, "C", 7), ("x", 2, "C", 7), ("x", 4, "G", 7), ("x", 5, None, 7), ("x", 6, "T", 7), ("x", 8, "", 7), ("y", 3, "A", 8), (None, 9, "N", 9), (None, 10, "A", 9), ("x", None, "Z", 7)]
    df = spark.createDataFrame(rows, "k string, p int, c string, other int").repartition(3)
    expected = [("x", 7, 1, "AC"), ("x", 7, 4, "G"), ("x", 7, 6, "T"), ("y", 8, 3, "A"), (None, 9, 9, "NA")]
    got = tables.joined_runs(df, "p", "c", "k", "other")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1, plan
    assert got.columns == ["k", "other", "start", "text"] and sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    monkeypatch.setattr(tables, "RUN", 4)
    long = spark.createDataFrame([(1, p, "ACGT"[p % 4]) for p in [*range(10), *range(11, 13)]], "k int, p int, c string")
    assert sorted(map(tuple, tables.joined_runs(long, "p", "c", "k").collect())) == [(1, 0, "ACGT"), (1, 4, "ACGT"), (1, 8, "AC"), (1, 11, "TA")]


def test_the_query_of_runs_calls_no_python(spark):
    from strandlake.plans import QUERIES

    assert "Python" not in QUERIES["sql_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
