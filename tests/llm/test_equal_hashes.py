"""Words of equal hashes are different words."""

import numpy as np

from strandlake.llm import substring_dedup as sd
from strandlake.llm._text import SPACED, Words


def twins():
    """Two words of 1,024 letters whose sums of products with powers of any odd base are equal modulo 2^64."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    return {r["doc_id"]: r["n_removed"] for r in sd.substring_dedup(df).collect()}


def test_words_of_equal_hashes(spark):
    import pyarrow as pa

    a, b = twins()
    h = Words(pa.array([f"{a} {b}"]), SPACED).hash
    assert h[0] == h[1] and a != b
    left, right = " ".join(f"l{i}" for i in range(12)), " ".join(f"r{i}" for i in range(12))
    # within a task's block, in a shard's equal segments, and inside longer segments that go to the index
    assert run(spark, [(1, f"{left} {a} {right}"), (2, f"{left} {b} {right}")]) == {1: 0, 2: 0}
    assert run(spark, [(1, f"{left} {a} {right}"), (2, f"x y {left} {b} {right} z"), (3, f"{left} {a} {right} q"), (4, f"p {left} {b} {right}")]) == {1: 0, 2: 0, 3: 25, 4: 25}
    assert run(spark, [(1, f"{left} {a} {right}"), (1, f"{left} {b} {right}"), (2, f"{left} {b} {right}")]) == {1: 0, 2: 25}


def test_symbols_are_words():
    import pyarrow as pa

    a, b = twins()
    got = sd.symbols(pa.array([f"{a} x {b}", "", f"x {a}", "n\x00l nul n l"], pa.large_string()))
    assert len(got) == 9 and len(set(got.tolist())) == 7 and got[0] == got[4] and got[1] == got[3] and got.min() == 1


def test_firsts_by_bytes():
    text = np.frombuffer(b"aabbaacc", np.uint8)
    begin, size, key = np.array([0, 2, 4, 6]), np.array([2, 2, 2, 2]), np.zeros(4, np.uint64)
    new, first = sd.grouped(np.array([0, 1, 2, 3]), key, begin, size, text)
    assert new.tolist() == [True, True, False, True] and first.tolist() == [0, 1, 0, 3]
