"""k-grams in very many surroundings do not bring them all to one shard, and what is removed stays the same."""

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import substring_dedup as sd
from strandlake.llm._text import SPACED, Words, rolled

SHARED = "alpha beta gamma delta"


def surrounded(n: int, seed: int = 5) -> list[str]:
    """n documents of 84 words of their own around four that all have."""
    r = np.random.default_rng(seed)
    numbers = r.integers(1 << 40, 1 << 41, (n, 80))
    return [" ".join(f"{x:x}" for x in row[:40]) + f" {SHARED} " + " ".join(f"{x:x}" for x in row[40:]) for row in numbers.tolist()]


def least_first(texts: list[str]) -> list[str]:
    """The texts with the shared words chosen so that their 4-gram's hash is small: it deals every window that holds it."""
    for i in range(200_000):
        shared = f"alpha{i} beta gamma delta"
        if rolled(Words(pa.array([shared]), SPACED).hash, 4)[0] < np.uint64(1 << 53):
            return [t.replace(SHARED, shared) for t in texts]
    raise AssertionError


def loads(texts: list[str], shards: int, frequent: sd.Frequent | None) -> np.ndarray:
    """Bytes of segments a shard."""
    out = np.zeros(shards)
    for at in range(0, len(texts), 5000):
        words = Words(pa.array(texts[at : at + 5000]), SPACED)
        start, windows, least = sd.segments(words, sd.WINDOW, sd.GRAM, frequent)
        size = words.end[start + windows + sd.WINDOW - 2] - words.start[start]
        out += np.bincount((least % np.uint64(shards)).astype(np.int64), size, minlength=shards)
    return out


def test_one_gram_in_many_documents(spark):
    texts = least_first(surrounded(50_000))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    shards = 64
    frequent = sd.frequent_grams(docs, shards, sd.GRAM, sd.FREQUENT)
    before, after = loads(texts, shards, None), loads(texts, shards, frequent)
    assert before.max() > 5 * before.mean()  # the gram's shard
    assert after.max() < 2 * before.mean()
    assert after.sum() < 1.1 * before.sum()  # the windows around it stay runs


@pytest.mark.parametrize("frequent", [0, 3, 40])
def test_results_do_not_depend_on_it(spark, frequent):
    from tests.llm.test_llm import brute_repeats

    r = np.random.default_rng(frequent)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [" ".join(r.choice(vocabulary, int(n))) for n in (25, 40, 21, 60)]
    texts = []
    for i in range(60):
        parts = [" ".join(r.choice(vocabulary, int(r.integers(0, 15)))) for _ in range(3)]
        texts.append(f" {passages[i % 4]} ".join(parts) + f" {SHARED} {SHARED}" * int(r.integers(0, 9)))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_repeats(rows)
    got = sd.substring_dedup(df, shard_bytes=600, frequent=frequent).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: tuple(w[:3]) for i, w in want.items()}
    assert sum(r["n_removed"] for r in got) > 1000


def test_bits():
    some = np.array([0, 7, 8, 63, 100])
    frequent = sd.Frequent(101, some)
    assert np.flatnonzero(frequent.holds(np.arange(101, dtype=np.uint64))).tolist() == some.tolist()


def test_windows_without_other_grams_go_by_their_own_hash():
    words = Words(pa.array([" ".join(f"w{i}" for i in range(30))]), SPACED)
    all_of_them = sd.Frequent(1, np.array([0]))
    start, windows, h = sd.segments(words, 20, 4, all_of_them)
    assert start.tolist() == list(range(11)) and windows.tolist() == [1] * 11
    assert (h == rolled(words.hash, 20)).all()
