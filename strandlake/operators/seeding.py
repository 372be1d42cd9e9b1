"""Aligning a table of queries with a table of references.

Both sides are reduced to minimizers: of each ``w`` neighbouring k-mers the one that an order puts first. Sequences that share
``w + k - 1`` bases in a row share a minimizer at the same place, so seeds that are joined by equality propose every such pair and
no other is looked at. Hits are told apart by their diagonal (place in the reference less place in the query), counted there, or
chained over the whole of both sequences (``collinear``).

Seeds that many references have are split: their references are dealt to several keys, to each of which the queries' rows are
sent. No seed and no hit is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement
from strandlake.operators.collinear import RESULT, best_chains
from strandlake.operators.superkmers import least_of
from strandlake.sources.scratch import scratch

K, W = 12, 6
#: Windows of k-mers of the pieces that sequences are cut into.
PIECE = 128
#: References of a seed that meet its queries in one key.
HOT = 1000
#: Seeds of more references are broadcast up to so many, else joined.
BROADCAST_SEEDS = 1_000_000


def minimizers(df: DataFrame, id_: str, seq: str, k: int = K, w: int = W, order: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, pos, seed): each place that is the first by ``order`` (ties: the leftmost) of some w neighbouring k-mers.

    A sequence of fewer k-mers is one window; one shorter than k, or null, has none. Sequences are cut into pieces of
    ``PIECE`` windows, so the cost follows the length and no array holds more than a piece. An id names one row.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w are at least 1")
    n = F.length("s") - (k - 1)  # k-mers
    base = df.select(F.col(id_).alias("id"), F.col(seq).alias("s")).where(n > 0)
    pieces = F.sequence(F.lit(0), F.floor(F.greatest(n - w, F.lit(0)) / PIECE).cast("int"))
    # a piece begins with the last window of the one before it, which tells whether its first choice is new
    lead = F.least(F.col("piece"), F.lit(1))
    at = base.select("id", "s", F.explode(pieces).alias("piece")).select("id", lead.alias("lead"), (F.col("piece") * PIECE - lead).alias("at"), F.substr("s", F.col("piece") * PIECE - lead + 1, lead + (PIECE + w + k - 2)).alias("s"))
    kmers = F.transform(F.sequence(F.lit(0), F.length("s") - k), lambda i: F.struct(order(F.substr("s", i + 1, F.lit(k))).alias("rank"), i.alias("i")))
    ranked = at.select("id", "lead", "at", "s", kmers.alias("kmers"))
    firsts = F.when(F.size("kmers") >= w, least_of(F.col("kmers"), w)).otherwise(F.array(F.array_min("kmers")))
    chosen = ranked.select("id", "lead", "at", "s", F.transform(firsts, lambda x: x["i"]).alias("firsts"))
    # choices never go back, so a place is new where it differs from the choice before
    new = F.filter("firsts", lambda i, j: F.when(j == 0, F.col("lead") == 0).otherwise(i != F.get("firsts", j - 1)))
    places = chosen.select("id", "at", "s", F.explode(new).alias("i"))
    return places.select("id", (F.col("at") + F.col("i")).alias("pos"), F.substr("s", F.col("i") + 1, F.lit(k)).alias("seed"))


def both_strands(df: DataFrame, id_: str, seq: str) -> DataFrame:
    """(id, seq, strand): each sequence, and turned."""
    return df.select(F.col(id_), F.col(seq), F.lit("+").alias("strand")).unionByName(df.select(F.col(id_), reverse_complement(F.col(seq)).alias(seq), F.lit("-").alias("strand")))


def hits(queries: DataFrame, references: DataFrame, hot: int = HOT) -> DataFrame:
    """(query, ref, query_pos, ref_pos, diag) of every two equal seeds of two frames of ``minimizers``.

    Only references' seeds that some query has are kept, and written once, as they are counted before they are joined.
    """
    path = scratch(references.sparkSession)
    references.join(queries.select("seed").distinct(), "seed", "left_semi").write.parquet(path)
    references = references.sparkSession.read.parquet(path)
    often = references.groupBy("seed").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    often = often.persist()
    n = often.count()
    q = queries.select(F.col("id").alias("query"), F.col("pos").alias("query_pos"), "seed")
    r = references.select(F.col("id").alias("ref"), F.col("pos").alias("ref_pos"), "seed")
    if n:
        few = F.broadcast(often) if n <= BROADCAST_SEEDS else often
        parts = F.coalesce("parts", F.lit(1))
        q = q.join(few, "seed", "left").select("query", "query_pos", "seed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        r = r.join(few, "seed", "left").select("ref", "ref_pos", "seed", F.pmod(F.xxhash64("ref", "ref_pos"), parts).cast("int").alias("part"))
        out = q.join(r, ["seed", "part"])
    else:
        out = q.join(r, "seed")
    often.unpersist()
    return out.select("query", "ref", "query_pos", "ref_pos", (F.col("ref_pos") - F.col("query_pos")).alias("diag"))


def diagonals(found: DataFrame) -> DataFrame:
    """(query, ref, diag, n_seeds): the diagonal of most seeds of each pair (ties: the least), by two aggregations."""
    counted = found.groupBy("query", "ref", "diag").agg(F.count("*").alias("n_seeds"))
    best = counted.groupBy("query", "ref").agg(F.max(F.struct("n_seeds", (-F.col("diag")).alias("less"))).alias("b"))
    return best.select("query", "ref", (-F.col("b.less")).alias("diag"), F.col("b.n_seeds").alias("n_seeds"))


def ungapped(query: Column, ref: Column, diag: Column) -> Column:
    """(matches, length): equal bases along a diagonal of two sequences, and how many bases it has in both."""
    a = F.substr(query, F.greatest(1 - diag, F.lit(1)), F.length(query))
    b = F.substr(ref, F.greatest(diag + 1, F.lit(1)), F.length(ref))
    n = F.greatest(F.least(F.length(a), F.length(b)), F.lit(0))
    cut = lambda x: F.split(F.substr(x, F.lit(1), n), "")
    same = F.size(F.filter(F.zip_with(cut(a), cut(b), lambda x, y: (x == y) & (x != "")), lambda x: x))
    return F.struct(same.alias("matches"), n.alias("length"))


def chains(found: DataFrame, k: int = K, band: int | None = None, block: int | None = None) -> DataFrame:
    """(query, ref, score, n_seeds, query_start, query_end, ref_start, ref_end): the best collinear chain of each pair.

    Of two chained hits both places ascend; a hit adds the bases that the one before it has not covered, less a quarter of
    the diagonals between them (rounded down). Equal scores: the least start in the reference, then in the query.
    A chain may have any of a pair's hits. Only where the caller asks for it, it stays within a ``band`` of diagonals or a ``block`` of
    bases of the reference; bands and blocks overlap by half.
    """
    halves = lambda x, size: F.array(F.floor(x * 2 / size).cast("bigint"), (F.floor(x * 2 / size) - 1).cast("bigint"))
    hits_, keys = found.select("query", "ref", F.col("ref_pos").alias("r"), F.col("query_pos").alias("q"), "diag"), ["query", "ref"]
    for name, x, size in (("band", "diag", band), ("block", "r", block)):
        if size is not None:
            hits_, keys = hits_.withColumn(name, F.explode(halves(F.col(x), size))), [*keys, name]
    best = best_chains(hits_, keys, k)
    if len(keys) > 2:  # the best of a pair's groups
        top = F.struct("score", (-F.col("ref_start")).alias("a"), (-F.col("query_start")).alias("b"), "n_seeds", "ref_end", "query_end")
        best = best.groupBy("query", "ref").agg(F.max_by(F.struct(*RESULT), top).alias("x")).select("query", "ref", "x.*")
    return best


def best_references(chained: DataFrame) -> DataFrame:
    """The chain of the highest score of each query (ties: the least reference)."""
    rest = [c for c in chained.columns if c not in ("query", "ref", "score")]
    key = F.struct(-F.col("score"), "ref")
    return chained.groupBy("query").agg(F.min_by(F.struct("ref", "score", *rest), key).alias("b")).select("query", "b.*")
