"""SimHash links, ranked search and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import lexical_search, simhash, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def prose(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def crowded(df):
    for c in ("doc_id_", "cell", "v", "first", "component", "fingerprint", "word", "run", "h", "n", "score", "query", "id", "rank"):
        df = df.withColumn(c, F.lit("kept"))
    return df


def smallest(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


# SimHash ---------------------------------------------------------------------------------------------------------------------


def literal_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def literal_simhash(rows, distance):
    prints = [(i, literal_fingerprint(t)) for i, t in rows]
    named = [(i, f) for i, f in prints if i is not None]
    links = [(a, b) for n, (a, f) in enumerate(named) for b, g in named[:n] if (f ^ g).bit_count() <= distance]
    root = smallest(links, {i for i, _ in named})
    return sorted((str(i), f"{f:016x}", str(root.get(i))) for i, f in prints)


def odd_rows(rnd):
    texts = [None, "", " \n\t", "one", "One two", "A a B b", "a A b B", "é\x00ß 𝔘 x  y z", "x" * 300]
    for i in range(120):
        t = prose(rnd, rnd.randint(1, 150), 60)
        texts += [t, t + " end", t] if i % 4 == 0 else [t]
    rows = list(enumerate(texts))
    return rows + [(3, "one"), (5, "another text of that id"), (None, "one"), (None, None), (-7, texts[40])]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_simhash_against_all_pairs(spark, distance):
    rows = odd_rows(random.Random(distance))
    for cell in (64, 2):  # with few and with most cells beyond the join
        out = simhash.near_duplicates(crowded(documents(spark, rows)).drop("fingerprint"), distance=distance, width=8 if distance > 2 else 4, cell=cell).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == literal_simhash(rows, distance)


def test_simhash_query_and_empty(spark, tmp_path):
    rows = odd_rows(random.Random(9))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op11_simhash(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == literal_simhash(rows, 2)
    assert simhash.near_duplicates(documents(spark, rows[:1]).limit(0)).count() == 0


def test_links_of_values(spark):
    """Random values, chains of them, and a crowd of all settings of ten bits, in which a cell has hundreds of members."""
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for v in list(values)[:60]:
        for _ in range(rnd.randint(1, 4)):
            v ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            values.add(v)
    base = rnd.getrandbits(64) & ~((1 << 12) - 1)
    values |= {base | x for x in range(1 << 10)}
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    array = np.array(values, np.uint64)
    close = np.bitwise_count(array[:, None] ^ array[None, :]) <= 2
    pairs = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint").repartition(4)
    for cell in (64, 100_000):
        got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(frame, cell=cell).collect()}
        assert got <= {tuple(sorted(p)) for p in pairs}
        assert smallest(got, signed) == smallest(pairs, signed)
        if cell == 64:  # the crowd's pairs are 28,160; what is emitted is a few links for each member
            assert len(got) < 15_000
        else:
            assert got == {tuple(sorted(p)) for p in pairs}


def test_popcounts(spark):
    values = [0, -1, 1 << 62, -(1 << 63), 0x0123456789ABCDEF]
    for width in (4, 8, 16):
        out = spark.createDataFrame([(v,) for v in values], "x bigint").select("x", simhash.popcounts(F.col("x"), width).alias("v"), simhash.nearby(simhash.popcounts(F.col("x"), width), 2, width).alias("c")).collect()
        for r in out:
            counts = [(r["x"] >> a & ((1 << width) - 1)).bit_count() for a in range(0, 64, width)]
            field = lambda v, width=width: [v >> a & ((1 << width) - 1) for a in range(0, 64, width)]
            assert field(r["v"]) == counts
            moved = {tuple(field(c)) for c in r["c"]}
            assert len(moved) == len(r["c"]) and all(sum(abs(p - q) for p, q in zip(m, counts, strict=True)) <= 2 and max(m) <= width for m in moved)


def test_long_text_fingerprint(spark):
    rnd = random.Random(8)
    text = prose(rnd, 400_000, 3000)
    grams = text.split()
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(grams[i : i + 3]), 42) for i in range(len(grams) - 2)), np.uint64)
    expected = sum(1 << j for j in range(64) if 2 * int(((h >> np.uint64(j)) & np.uint64(1)).sum()) > len(h))
    out = simhash.fingerprints(documents(spark, [(1, text), (2, "a b c")])).where("doc_id = 1").first()
    assert out["fingerprint"] == int(np.uint64(expected).view(np.int64))


# Ranked search -----------------------------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def literal_search(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    queries = {}
    for i, t in sorted({(i, t or "") for i, t in items if i is not None}):
        queries.setdefault(i, Counter()).update(terms_of(t))
    for q, asked in queries.items():
        scored = []
        for i, c in counted:
            m = 100 - 75 + 75 * c.total() * n // total
            s = sum(k * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def test_numbers_of_seven_bits():
    rnd = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 63) - 1] + [rnd.getrandbits(rnd.randint(1, 62)) for _ in range(2000)], np.int64)
    data, size = lexical_search.pack(values)
    assert (lexical_search.unpack(data) == values.astype(np.uint64)).all() and size.sum() == len(data)
    assert len(lexical_search.unpack(np.zeros(0, np.uint8))) == 0 and len(lexical_search.pack(np.zeros(0, np.int64))[0]) == 0


@pytest.mark.parametrize("shard_bytes", [1, 3000, 8 << 20])
def test_search_against_all_documents(spark, shard_bytes):
    rnd = random.Random(shard_bytes)
    docs = [(rnd.randrange(-500, 500), prose(rnd, rnd.randint(0, 60), rnd.choice([5, 50, 500]))) for _ in range(400)]
    docs += [(i, t) for i, t in docs[:30]] + [(None, docs[3][1]), (None, docs[4][1]), (7000, None), (7001, ""), ((1 << 63) - 1, docs[3][1]), (-(1 << 63), docs[3][1]), (7002, "É É é ß 𝔘 w1-w2_w3")]
    items = [(i, prose(rnd, rnd.randint(1, 25), 60)) for i in range(25)] + [(1, "w1 w2"), (1, "w1 w2"), (None, "w1"), (30, None), (31, ""), (32, "nothing here"), (33, "É w1 w1 w1 w1"), (34, docs[3][1])]
    shards = lexical_search.index(crowded(documents(spark, docs)), shard_bytes=shard_bytes)
    shards = shards.persist()
    queries = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit("x")).repartition(2)
    for block_bytes in (4 << 20, 40):
        out = lexical_search.search(shards, queries, block_bytes=block_bytes)
        got = sorted((r["item_id"], r["rank"], r["score"], r["doc_id"]) for r in out.collect())
        assert got == sorted((q, r, s, i) for q, r, i, s in literal_search(docs, items))
    shards.unpersist()


def test_search_of_nothing(spark):
    empty, items = documents(spark, [(1, "x")]).limit(0), spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    assert lexical_search.search(lexical_search.index(empty), items).count() == 0
    some = lexical_search.index(documents(spark, [(1, "x y"), (2, "z")]))
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_lists_that_leave_the_merge():
    """Random lists with many ties, in random shards: the heap's results equal those of all documents."""
    rnd = random.Random(6)
    for _ in range(300):
        found, every = [], {}
        query = [(t, rnd.randint(1, 2)) for t in range(rnd.randint(1, 8))]
        for shard in range(3):
            ids = sorted(rnd.sample(range(100), rnd.randint(1, 30)))
            lists = {}
            for t, q in query:
                docs = sorted(rnd.sample(range(len(ids)), rnd.randint(0, len(ids))))
                if docs:
                    scores = [rnd.randint(0, 3) * (t + 1) for _ in docs]
                    lists[t] = (docs, scores, max(scores), dict(zip(docs, scores, strict=True)))
                    for d, s in zip(docs, scores, strict=True):
                        every[shard, ids[d]] = every.get((shard, ids[d]), 0) + s * q
            lexical_search.best([x for x in query if x[0] in lists], lists, ids, found, 5)
        expected = sorted(((s, -i) for (_, i), s in every.items() if s > 0), reverse=True)[:5]
        assert sorted(found, reverse=True) == expected


# Spelling variants ---------------------------------------------------------------------------------------------------------------


def literal_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def literal_variants(words):
    near = {w: sorted(x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)) for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def misspelt(rnd, w):
    p, c = rnd.randrange(len(w)), rnd.choice("abcdeé")
    return rnd.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]])


def spelt_rows(rnd):
    base = ["".join(rnd.choice("aabbcdeéÿ×") for _ in range(rnd.randint(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "Abababa", "ÉÉÉÉÉÉ", "bbbbbbc"]
    words = [w for w in base for _ in range(rnd.choice([5, 30, 150, 800]))]
    for w in base:
        x = w
        for k in (40, 6):
            x = misspelt(rnd, x)
            words += [x] * k
    rnd.shuffle(words)
    rows = [(i, rnd.choice([" ", ". ", "1"]).join(words[a : a + 50])) for i, a in enumerate(range(0, len(words), 50))]
    return rows + [(None, "aaaaaa aaaaaab short"), (None, None), (900, ""), (900, "×××××× 日本語日本語 aaaaaa")] + [rows[0]] * 3


def test_spelling_against_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = spelt_rows(random.Random(seed))
        out = spelling.variants(crowded(documents(spark, rows)))
        got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()}
        expected = literal_variants(literal_words(rows))
        assert got == expected and any(f and r != f for _, f, r, *_ in expected)
    assert spelling.variants(documents(spark, rows).limit(0)).count() == 0


def test_pairs_are_found_once(spark):
    """Runs of equal letters over the halves' border, all lengths, and words beyond the hashed length."""
    rnd = random.Random(3)
    words = {"a" * n for n in range(6, 30)} | {"a" * p + "b" + "a" * (9 - p) for p in range(10)}
    long_ = "".join(rnd.choice("abé") for _ in range(300))
    words |= {long_, long_[:150] + "c" + long_[151:], long_[:20] + long_[21:], long_ + "z", "z" + long_} | {"x" * n for n in range(250, 262)} | {"x" * p + "y" + "x" * (299 - p) for p in (0, 1, 149, 150, 151, 299)} | {"x" * 299, "x" * 300, "x" * 301}
    frame = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n bigint").repartition(3)
    got = sorted(tuple(r) for r in spelling.near_pairs(frame).collect())
    assert got == sorted((a, b, len(b)) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_roots_of_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"x{i}", "w0") for i in range(300)]
    out = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert len(out) == 340 and {r["root"] for r in out} == {"w40"}
