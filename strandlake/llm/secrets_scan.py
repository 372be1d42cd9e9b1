"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived: trigrams that every match must hold, joined by
AND along the expression and by OR over its alternatives. The distinct trigrams of all queries are the index's terms, in
lower case. The index (``postings``) is a table of posting lists: for each term and block of texts the keys of the texts
that hold the term. Lists of a block are intersected and united as a rule's query says, which gives the rule's candidates;
only these are verified with the expression. Rules without a mandatory trigram scan every text.

A text's key is its 64-bit hash, so copies are one entry, and a collision only makes a candidate more. Blocks are ranges of
keys, about ``BLOCK`` rows each, so no list grows with the input. Candidates meet the texts by a broadcast up to
``BROADCAST_KEYS`` of them, else by a join that adaptive execution can split where one text is very frequent.

Everything is native. Starts of matches are sums over the texts between them, taken in runs, so the cost of a text follows
its matches.

Cases: null and empty texts have no spans; rows that repeat an id or a text are scanned each; no rows give no rows; other
columns stay, whatever they are called; a rule that matches the empty string is refused; matches shorter than a rule asks
for are dropped after the leftmost non-overlapping matches are found; spans that start together come in the rules' order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import free, quoted

#: Rows of a block of the index, and candidates that are broadcast.
BLOCK, BROADCAST_KEYS = 16_384, 2_000_000


@dataclass(frozen=True)
class Rule:
    """kind: a name; pattern: in the syntax that Java and Python share; at_least: code points of ``group`` that a match needs."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: Fixed patterns.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules beside the base: public formats of tokens and keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str):
    """A query over lower-case trigrams: ("and", parts), ("or", parts), ("has", trigram) or None, which every text fulfils."""
    parser = re._parser if hasattr(re, "_parser") else __import__("sre_parse")
    tree = parser.parse(pattern)
    queries = [_needed(alternative) for alternative in _exact(list(tree))]
    return _any(queries)


#: Beyond so many literal alternatives a part of an expression is not spelled out.
SPELLED = 64


def _exact(items: list) -> list[list]:
    """Alternatives, each a list of literal strings and of None for what may be anything."""
    out: list[list] = [[""]]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            options = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            options = _exact(list(arg[-1]))
        elif name == "BRANCH":
            options = [o for branch in arg[1] for o in _exact(list(branch))]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            if low == 0 and high == 1 and len(inner) == 1:
                options = [[""], *_exact(list(inner))]
            elif low:
                once = _exact(list(inner))
                options = [[*o, None] if high != 1 else o for o in once]
            else:
                options = [[None]]
        elif name == "IN" and len(arg) <= 8 and all(str(k) == "LITERAL" and v < 128 for k, v in arg):
            options = [[chr(v).lower()] for _, v in arg]
        elif name == "AT":
            options = [[""]]
        else:
            options = [[None]]
        if len(out) * len(options) > SPELLED:
            options = [[None]]
        out = [_glued(a, b) for a in out for b in options]
    return out


def _glued(a: list, b: list) -> list:
    if a and b and a[-1] is not None and b[0] is not None:
        return [*a[:-1], a[-1] + b[0], *b[1:]]
    return [*a, *b]


def _needed(parts: list):
    grams = sorted({p[i : i + 3] for p in parts if p for i in range(len(p) - 2)})
    return ("and", [("has", g) for g in grams]) if grams else None


def _any(queries: list):
    return None if any(q is None for q in queries) else ("or", queries)


def terms(query) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "has" else set().union(*map(terms, query[1]))


def alternatives(query) -> list[frozenset[str]]:
    """The sets of terms of a query's alternatives, without those that ask for all of another and more."""
    sets = {frozenset(terms(part)) for part in query[1]}
    return sorted((c for c in sets if not any(o < c for o in sets)), key=sorted)


class TrigramIndex:
    """The rules' terms and queries: for each kind the alternatives of its query, each a list of terms' numbers; None where
    every text is a candidate."""

    def __init__(self, rules) -> None:
        queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.terms = sorted({t for q in queries.values() if q is not None for c in alternatives(q) for t in c})
        place = {t: i for i, t in enumerate(self.terms)}
        self.clauses = {k: None if q is None else [sorted(place[t] for t in c) for c in alternatives(q)] for k, q in queries.items()}

    def postings(self, texts: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
        """(block, term, keys): the posting list of each term in each block."""
        low = F.lower(F.col(text))
        held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(self.terms)]))
        rows = texts.select(F.col(key).alias("key"), low.alias("low")).select("key", F.explode(held).alias("term"))
        return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "term").agg(F.collect_set("key").alias("keys"))

    def candidates(self, postings: DataFrame, kinds: list[str]) -> DataFrame:
        """(key, rules): the texts that a rule's query leaves, and a bit for each such rule by its place in ``kinds``."""
        lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "keys"))).alias("lists"))
        none = F.array().cast("array<bigint>")
        of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
        asked = []
        for i, kind in enumerate(kinds):
            for clause in self.clauses[kind] or []:
                found = reduce(F.array_intersect, [of(t) for t in clause])
                asked.append(F.transform(found, _marked(1 << i)))
        if not asked:
            return postings.sparkSession.createDataFrame([], "key bigint, rules bigint")
        rows = lists.select(F.explode(F.flatten(F.array(*asked))).alias("c")).select("c.*")
        return rows.groupBy("key").agg(F.bit_or("rules").alias("rules"))


def _marked(bit: int):
    return lambda k: F.struct(k.alias("key"), F.lit(bit).cast("bigint").alias("rules"))


SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"
RUN = 64


def measured(rule: Rule, rank: int, text: Column, found: Column) -> Column:
    """The rule's matches ``found`` as lengths: for each the text before it, the match and what must be long enough."""
    gaps = F.split(text, rule.pattern, -1)
    size = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), size.alias("size"))
    lengths = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["found"]).cast("bigint").alias("found"), (F.length(x["size"]) >= rule.at_least).alias("holds")))
    none = F.array().cast("array<struct<gap: bigint, found: bigint, holds: boolean>>")
    return F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.when(F.size(found) > 0, lengths).otherwise(none).alias("lengths"))


def placed(rule: Column) -> Column:
    """Spans (start, rank, end, kind) of a rule's measured matches, in code points, end exclusive.

    Starts are sums of lengths: first over runs of ``RUN`` matches, then within each run.
    """
    lengths = rule["lengths"]
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda i: F.slice(lengths, i * RUN + 1, F.lit(RUN)))
    zero = F.lit(0).cast("bigint")
    sums = F.transform(runs, lambda r: F.aggregate(r, zero, lambda a, x: a + x["gap"] + x["found"]))
    before = F.aggregate(sums, F.array(zero), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), rule["rank"].alias("rank"), (start + x["found"]).alias("end"), rule["kind"].alias("kind"))
        return F.struct((start + x["found"]).alias("at"), F.when(x["holds"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    of = lambda r, at: F.aggregate(r, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step)["spans"]
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), of))).otherwise(F.array().cast(SPAN))


def scan(documents: DataFrame, *, text: str = "text", rules=RULES, into: str = "secrets", block: int = BLOCK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The frame with a column ``into``: all spans of the rules, by start and then by the rules' order."""
    for r in rules:
        if re.fullmatch(r.pattern, ""):
            raise ValueError(f"rule {r.kind} matches the empty string")
    if len(rules) > 62:
        raise ValueError("62 rules at most")
    index, kinds = TrigramIndex(rules), [r.kind for r in rules]
    t, k, mask, hits, *found = free(documents.columns, "text_", "key_", "rules_", "hits_", *(f"found{i}_" for i in range(len(rules))))
    base = documents.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit(""))).withColumn(k, F.xxhash64(t))
    if index.terms:
        blocks = -(-documents.count() // block) or 1
        chosen = stored(index.candidates(index.postings(base, k, t, blocks), kinds)).select(F.col("key").alias(k), F.col("rules").alias(mask))
        base = base.join(F.broadcast(chosen) if chosen.count() <= broadcast_keys else chosen, k, "left")
    else:
        base = base.withColumn(mask, F.lit(None).cast("bigint"))
    if not rules:
        return base.withColumn(into, F.array().cast(SPAN)).select(*[F.col(quoted(c)) for c in documents.columns if c.lower() != into.lower()], into)
    asked = [F.col(t).rlike(_long_enough(r)) if index.clauses[r.kind] is None else F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0 for i, r in enumerate(rules)]
    base = base.select("*", *[F.when(a, F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))).alias(f) for a, r, f in zip(asked, rules, found, strict=True)])
    base = base.withColumn(hits, F.array(*[measured(r, i, F.col(t), F.col(f)) for i, (r, f) in enumerate(zip(rules, found, strict=True))]))
    base = base.withColumn(into, F.array_sort(F.flatten(F.transform(hits, placed))))
    return base.select(*[F.col(quoted(c)) for c in documents.columns if c.lower() != into.lower()], into)


def _long_enough(rule: Rule) -> str:
    """The rule's expression, or for one run of a class the same with its least length: what a scanned row must match to have spans."""
    m = re.fullmatch(r"(.*\])\+", rule.pattern)
    if rule.group or rule.at_least < 2 or not m:
        return rule.pattern
    lead = len(re.sub(r"\[[^\]]*\]\Z", "", m[1]))
    return f"{m[1]}{{{max(rule.at_least - lead, 1)},}}"


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced; spans that touch or overlap become one mark."""
    zero = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        touches = F.when(F.size(acc) > 0, s["start"] <= last["end"]).otherwise(F.lit(False))
        return F.when(touches, longer).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate(spans, zero, step)

    def kept(s: Column, i: Column) -> Column:
        since = F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(F.lit(0).cast("bigint"))
        return F.substring(text, (since + 1).cast("int"), (s["start"] - since).cast("int"))

    end = F.element_at(merged, -1)["end"]
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(merged, kept), mark), F.lit(mark), F.substring(text, (end + 1).cast("int"), F.length(text))))


def redact(documents: DataFrame, *, text: str = "text", rules=RULES, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every secret of their texts replaced by the mark, and the same columns."""
    (spans,) = free(documents.columns, "spans_")
    found = scan(documents, text=text, rules=rules, into=spans)
    return found.withColumn(text, redacted(F.col(quoted(text)), F.col(spans), mark)).select(*[quoted(c) for c in documents.columns])


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents, by the base rules and those beside them."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE_RULES))
    return out.select("doc_id", *[of(r.kind) for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
