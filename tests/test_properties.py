"""Properties over generated records."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.operators import alignment as al
from strandlake.sources.fasta import fasta_line, read_fasta
from strandlake.sources.fastq import entries, fault, parse
from strandlake.sources.sam import records_of, sam_line
from tests import strategies as own
from tests.test_sites import paired

quick = settings(max_examples=60, deadline=None)


@quick
@given(st.lists(own.fastq(), max_size=6))
def test_fastq_text_and_back(records):
    lines = [x for h, s, q in records for x in ("@" + h, s, "+", q)]
    assert list(parse(lines)) == records


@quick
@given(st.lists(own.fastq(), min_size=1, max_size=6), st.data())
def test_a_fault_loses_no_other_record(records, data):
    """After a record without its quality line, those that follow the next one are read."""
    lines = [x for h, s, q in records for x in ("@" + h, s, "+", q)]
    at = data.draw(st.integers(0, len(records) - 1))
    broken = lines[: 4 * at + 3] + lines[4 * at + 4 :]
    got = [e[:3] for e in entries((0, x) for x in broken) if e[3] is None]
    kept = [r for i, r in enumerate(records) if i != at]
    assert all(r in got for i, r in enumerate(kept) if i < at)
    assert fault("@x", "AC", "+", "I") and not fault("@x", "AC", "+", "II")


@quick
@given(own.aligned())
def test_paths(case):
    ref, query, cigar = case
    a, b = paired(ref, query, cigar, 0)
    assert len(a) == len(b) and a.replace("-", "") == ref and b.replace("-", "") == query
    plain = al.verbose(ref, query, cigar, 0)
    assert sum(n for n, op in al.ciglets(plain) if op in "=X") == sum(n for n, op in al.ciglets(cigar) if op == "M")
    w = al.Weights.dna(2, -3, None)
    expected = sum(w.get(x, y) for x, y in zip(a, b, strict=True) if "-" not in (x, y)) + sum(-5 - (n - 1) for n, op in al.ciglets(cigar) if op in "ID")
    assert al.rescore(ref, query, cigar, 0, w, -5, -1, "global") == expected
    if ref and query:
        assert al.align_pair(ref, query, w, -5, -1, "global")[1] >= expected
    cut = al.sliced(cigar, 0, len(ref), len(query), 0, len(ref))
    if ref:
        assert cut is not None and sum(n for n, op in al.ciglets(cut[2]) if op in "MIS") == len(query)


@settings(max_examples=1, deadline=None)
@given(st.lists(own.ciglets(), min_size=60, max_size=60))
def test_cigar_columns(spark, cases):
    texts = ["".join(f"{n}{op}" for n, op in c) for c in cases]
    c = F.col("c")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", cg.is_valid(c), cg.ref_len(c), cg.query_len(c), cg.expanded(c), cg.reversed_cigar(c), cg.of_ciglets(cg.merged(cg.ciglets(c)))).collect()
    for i, valid, ref, query, expanded, turned, merged in rows:
        case = cases[i]
        assert valid and merged == texts[i]
        assert ref == sum(n for n, op in case if op in "MDN=X") and query == sum(n for n, op in case if op in "MIS=X")
        assert expanded == "".join(op * n for n, op in case) and turned == "".join(f"{n}{op}" for n, op in reversed(case))


@settings(max_examples=1, deadline=None)
@given(st.lists(own.sam(), min_size=40, max_size=40))
def test_sam_text_and_back(spark, cases):
    lines = ["\t".join([*fields, *tags]) for fields, tags in cases]
    rows = records_of(spark.createDataFrame([(x,) for x in lines], "value string"))
    again = sorted(r[0] for r in rows.select(sam_line({c: F.col(c) for c in rows.columns})).collect())
    assert again == sorted(lines)


@settings(max_examples=1, deadline=None)
@given(records=st.lists(own.fasta(), min_size=30, max_size=30))
def test_fasta_text_and_back(spark, tmp_path_factory, records):
    records = [(h.replace(">", "x"), s) for h, s in records if h.strip()]
    path = tmp_path_factory.mktemp("fasta") / "a"
    frame = spark.createDataFrame(records, "name string, sequence string")
    frame.select(fasta_line(F.col("name"), F.col("sequence"))).write.text(str(path))
    assert sorted(map(tuple, read_fasta(spark, str(path)).collect())) == sorted(records)


def test_generators_reject_nothing_valid():
    with pytest.raises(ValueError):
        list(parse(["@", "A", "+", "I"]))
