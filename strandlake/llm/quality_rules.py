"""Quality rules: base counts, and divergence from language references.

Two histograms of a text, of character classes and of common words, are compared with the reference of its language by the
Jensen-Shannon distance (base 2, from 0 to 1). A reference is the mean of the normalised histograms of all documents of
the language that are long enough; every language has one of its own, and null languages and those without such a document
take the reference of all documents. The references of the ``max_languages`` most frequent languages are broadcast; where
there are more, the rows of the others are joined with theirs by a shuffle. Texts of fewer
characters or words than the guards ask for are not judged by that histogram.

Everything is native and works inside the row: words are an array, repeated windows are found by sorting the hashes of a
text's windows, and only the references are aggregated (with map-side combine, a row a language).

Cases: null text has no words and no lines; a text of few words fails the base rule; rows that repeat a doc_id are judged
each, equal texts alike; no rows give no rows; clashing column names of the input are no matter, as only the id, the text and
the language are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import quoted

#: Common words of four languages; fixed values.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "nicht",
    "de", "la", "le", "et", "les", "du", "un", "une", "que", "qui", "dans", "pour",
    "el", "en", "y", "a", "los", "se", "las", "por", "con", "para", "no", "su",
)
LETTERS = "".join(chr(33 + i) for i in range(len(COMMON_WORDS)))
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEATED_PERCENT = 50, 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 100
#: A distance is too far above its base plus spread / sqrt(words), as a short text's histogram strays from its language's.
CLASS_LIMIT, WORD_LIMIT = (0.17, 0.8), (0.2, 1.0)
#: References are broadcast for so many languages, else joined.
MAX_LANGUAGES = 64


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_CLASS))


def counted(documents: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """The base counts and both histograms of each document."""
    out = documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(lang)).alias("lang"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    out = out.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    w = F.col("words")
    grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    # each common word as one letter, so that counts are lengths
    place = F.array(*[F.lit(x) for x in COMMON_WORDS])
    letter = lambda x: F.substr(F.lit(LETTERS), F.array_position(place, x).cast("int"), F.lit(1))
    length = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    out = out.select(
        "doc_id",
        "lang",
        F.size(w).alias("n_words"),
        F.length(F.array_join(w, "")).alias("word_chars"),
        F.length("text").alias("chars"),
        length(r"[^#*$%&|<>]+").alias("n_symbols"),
        length(r"[^\p{Lu}]+").alias("n_upper"),
        length(r"[^\p{Nd}]+").alias("n_digits"),
        length(r"[^\p{P}]+|[#*%&]+").alias("n_points"),
        lines.alias("lines"),
        grams.alias("grams"),
        F.array_join(F.transform(F.filter(w, lambda x: x.isin(*COMMON_WORDS)), letter), "").alias("common"),
    )
    # windows by hash; a neighbour with the same hash makes both repeated
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed)).drop("grams")
    p = F.col("placed")
    hits = F.transform(p, lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"]))
    out = out.withColumn("hits", F.sort_array(F.array_compact(hits))).drop("placed")
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"]
    c = F.col("common")
    return out.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.array(F.greatest(F.col("word_chars") - F.col("n_upper") - F.col("n_digits") - F.col("n_points") - F.col("n_symbols"), F.lit(0)), "n_upper", "n_digits", "n_points", "n_symbols", F.col("chars") - F.col("word_chars")).alias("classes"),
        F.array(F.col("n_words") - F.length(c), *[F.length(c) - F.length(F.replace(c, F.lit(x))) for x in LETTERS]).alias("common"),
    )


def normalised(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two distributions (arrays of one length)."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(rows: DataFrame) -> tuple[DataFrame | None, list[float] | None, list[float] | None]:
    """A frame (_lang, n, class_reference, word_reference) of all languages, and the references of all documents."""
    judged = rows.where((F.col("word_chars") >= MIN_CHARS_JUDGED) & (F.col("n_words") >= MIN_WORDS_JUDGED))
    judged = judged.select("lang", normalised(F.col("classes")).alias("c"), normalised(F.col("common")).alias("w"))
    sizes = (6, len(COMMON_WORDS) + 1)
    sums = [F.count("*").alias("n"), *[F.sum(F.col(k)[i]).alias(f"{k}{i}") for k, n in zip("cw", sizes, strict=True) for i in range(n)]]
    table = stored(judged.groupBy("lang").agg(*sums))
    parts = lambda r: [[r[f"{k}{i}"] / r["n"] for i in range(n)] for k, n in zip("cw", sizes, strict=True)]
    whole = table.agg(F.sum("n").alias("n"), *[F.sum(f"{k}{i}").alias(f"{k}{i}") for k, n in zip("cw", sizes, strict=True) for i in range(n)]).first()
    if not whole["n"]:
        return None, None, None
    mean = lambda k, n: F.array(*[F.col(f"{k}{i}") / F.col("n") for i in range(n)])
    frame = table.where("lang is not null").select(F.col("lang").alias("_lang"), "n", mean("c", sizes[0]).alias("class_reference"), mean("w", sizes[1]).alias("word_reference"))
    return frame, *parts(whole)


def with_references(rows: DataFrame, frame: DataFrame, max_languages: int) -> DataFrame:
    """The rows with their language's references, null where it has none."""
    if len(frame.take(max_languages + 1)) <= max_languages:
        return rows.join(F.broadcast(frame.drop("n")), rows["lang"] == F.col("_lang"), "left")
    top = stored(frame.orderBy(F.desc("n"), "_lang").limit(max_languages))
    rest = frame.join(F.broadcast(top.select("_lang")), "_lang", "left_anti").drop("n")
    # a frequent language's rows, and those of none, do not meet in one task
    near = rows.join(F.broadcast(top.drop("n")), rows["lang"] == F.col("_lang"), "left")
    far = near.where("_lang is null and lang is not null").select(*rows.columns)
    return near.where("_lang is not null or lang is null").unionByName(far.join(rest, far["lang"] == F.col("_lang"), "left"))


def judge(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", class_limit: tuple[float, float] = CLASS_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """A row for each document: its counts, class_distance and word_distance (null where too short), base_failed and kept."""
    rows = stored(counted(documents, doc_id, text, lang))
    frame, classes, words = references(rows)
    if frame is None:
        none = F.lit(None).cast("double")
        out = rows.withColumn("class_distance", none).withColumn("word_distance", none)
    else:
        literal = lambda x: F.array(*[F.lit(float(v)) for v in x])
        joined = with_references(rows, frame, max_languages)
        out = joined.withColumn("class_distance", F.when(F.col("word_chars") >= MIN_CHARS_JUDGED, distance(normalised(F.col("classes")), F.coalesce("class_reference", literal(classes)))))
        out = out.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS_JUDGED, distance(normalised(F.col("common")), F.coalesce("word_reference", literal(words)))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * F.lit(100).cast("bigint") > F.col("n_words") * F.lit(REPEATED_PERCENT).cast("bigint"))
    over = lambda name, limit: F.coalesce(F.col(name) > F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(False))
    far = over("class_distance", class_limit) | over("word_distance", word_limit)
    longs = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *longs, failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_distance", "word_distance")
