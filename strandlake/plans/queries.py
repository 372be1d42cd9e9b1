"""One query for each family of operators, over whole tables and whole texts.

The tables hold prose; sequences come from it by the same rule in Spark and in SQL: ``dna`` is the text's letters ACGTUN in
upper case with T for U, ``iupac`` its letters of the IUPAC alphabet and gaps, ``aa`` its ASCII letters that are residues,
``qual`` its graphic ASCII characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions import composition as cp
from strandlake.functions import distance as ds
from strandlake.functions import sequence as sq
from strandlake.functions.alphabets import AMINO_ACIDS, RECODE, REFINE, VALID
from strandlake.operators import alignment as al
from strandlake.operators import composition as oc
from strandlake.operators import kmers as km
from strandlake.operators import sam as sm
from strandlake.sources.fasta import fasta_line
from strandlake.sources.fastq import fastq_line
from strandlake.sources.sam import sam_line

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys over all cores: a table of few bytes has few scan splits, however much work its rows make."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dna(text: str) -> Column:
    return F.translate(F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ACGTUNacgtun]+", "")), "U", "T")


def iupac(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^ACGTURYSWKMBDHVNacgturyswkmbdhvn.:~\-]+", "")


def residues(text: str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]+", ""))


def quality(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^!-~]+", "")


DNA = "replace(upper(regexp_replace(coalesce(text, ''), '[^ACGTUNacgtun]+', '', 'g')), 'U', 'T')"
SEQ = r"regexp_replace(coalesce(text, ''), '[^ACGTURYSWKMBDHVNacgturyswkmbdhvn.:~\-]+', '', 'g')"
AA = f"upper(regexp_replace(coalesce(text, ''), '[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]+', '', 'g'))"
QUAL = "regexp_replace(coalesce(text, ''), '[^!-~]+', '', 'g')"
T = "text"


def _windows(seq: str, k: int) -> str:
    return f"[substring({seq}, i + 1, {k}) for i in range(0, greatest(length({seq}) - {k - 1}, 0))]"


# K-mers ---------------------------------------------------------------------------------------------------------------


def _kmer_sql(source: str, k: int) -> str:
    return f"select unnest({_windows('s', k)}) as kmer from (select {DNA} as s from {source})"


@query(f"select kmer, count(*) as count from ({_kmer_sql('documents', 5)}) group by kmer order by count desc, kmer limit 20")
def kmer_top(spark, sf_dir):
    counts = km.kmer_counts(table(spark, sf_dir, "documents").select(dna(T).alias("s")), "s", 5)
    return counts.orderBy(F.desc("count"), "kmer").limit(20)


@query(f"select kmer, count(*) as count from ({_kmer_sql('documents', 6)}) group by kmer")
def kmer_counts(spark, sf_dir):
    return km.kmer_counts(table(spark, sf_dir, "documents").select(dna(T).alias("s")), "s", 6)


@query(f"select distinct replace(kmer, 'N', 'A') as kmer from ({_kmer_sql('documents', 5)})")
def kmer_set_two_bit(spark, sf_dir):
    return km.kmer_set(table(spark, sf_dir, "documents").select(dna(T).alias("s")), "s", 5, bits=2)


_CODE3 = " + ".join(f"(position(substring(kmer, {i + 1}, 1) in 'NACGT') + 2) * {8 ** (6 - i)}" for i in range(7))


@query(f"select distinct kmer, cast({_CODE3} as bigint) as code, kmer as decoded from ({_kmer_sql('benchmark', 7)})")
def kmer_encoding(spark, sf_dir):
    out = km.kmer_set(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 7).withColumn("code", km.encode(F.col("kmer")))
    return out.withColumn("decoded", km.decode(F.col("code"), 7))


_VARIED = " union ".join(f"select substring(kmer, 1, {i}) || b || substring(kmer, {i + 2}) as kmer, c from base, (values ('N'), ('A'), ('C'), ('G'), ('T')) v(b) where b <> substring(kmer, {i + 1}, 1)" for i in range(5)).replace(" union ", " union all ")


@query(f"with base as (select kmer, count(*) as c from ({_kmer_sql('benchmark', 5)}) group by kmer), every as (select kmer, c from base union all {_VARIED}) select kmer, cast(sum(c) as bigint) as count from every group by kmer")
def kmer_variants(spark, sf_dir):
    return km.kmer_counts(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 5, mismatches=1)


@query(
    f"with a as (select distinct kmer from ({_kmer_sql('benchmark', 6)})), b as (select distinct kmer from ({_kmer_sql('conversations', 6)})) "
    "select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersection', count(*) from (select * from a intersect select * from b) "
    "union all select 'difference', count(*) from (select * from a except select * from b) union all select 'symmetric_difference', count(*) from ((select * from a except select * from b) union all (select * from b except select * from a))"
)
def kmer_set_algebra(spark, sf_dir):
    a, b = (km.kmer_set(table(spark, sf_dir, t).select(dna(T).alias("s")), "s", 6) for t in ("benchmark", "conversations"))
    out = None
    for f in (km.union, km.intersection, km.difference, km.symmetric_difference):
        row = f(a, b).agg(F.count("*").alias("n")).select(F.lit(f.__name__).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query(
    f"with p as (select distinct kmer from ({_kmer_sql('benchmark', 9)})), w as (select doc_id, unnest(range(0, greatest(length(s) - 8, 0))) as pos, s from (select doc_id, {DNA} as s from documents)) "
    "select doc_id, min(pos) as first_start, max(pos) as last_start, count(*) as n, max(pos) + 9 as last_end from w join p on substring(s, pos + 1, 9) = kmer group by doc_id"
)
def kmer_search(spark, sf_dir):
    probe = km.kmer_set(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 9)
    found = km.find_all(table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s")), "doc_id", "s", probe, 9)
    return found.groupBy("doc_id").agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.count("*").alias("n"), F.max("end").alias("last_end"))


@query(f"with c as (select kmer, count(*) as n from ({_kmer_sql('documents', 8)}) group by kmer) select a.kmer, coalesce(c.n, 0) as count from (select distinct kmer from ({_kmer_sql('benchmark', 8)})) a left join c on a.kmer = c.kmer")
def kmer_lookup(spark, sf_dir):
    probe = km.kmer_set(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 8)
    return km.contains(probe, km.kmer_counts(table(spark, sf_dir, "documents").select(dna(T).alias("s")), "s", 8))


# Validation and recoding ------------------------------------------------------------------------------------------------


#: Classes of the checks, stated again for SQL.
_VALID_SQL = {
    "iupac_no_gaps": "ACGTURYSWKMBDHVNacgturyswkmbdhvn",
    "iupac_no_gaps_uc": "ACGTURYSWKMBDHVN",
    "iupac_with_gaps": "ACGTURYSWKMBDHVNacgturyswkmbdhvn.-",
    "iupac_with_gaps_uc": "ACGTURYSWKMBDHVN.-",
    "acgtn_no_gaps": "ACGTNacgtn",
    "acgtn_no_gaps_uc": "ACGTN",
    "acgtn_std_gaps_uc": "ACGTN-",
    "acgt_no_gaps": "ACGTacgt",
    "acgt_no_gaps_uc": "ACGT",
}


@query("select doc_id, " + ", ".join(f"length(regexp_replace(s, '[{v}]+', '', 'g')) = 0 as {k}, length(regexp_replace(s, '[^{v}]+', '', 'g')) as kept_{k}" for k, v in _VALID_SQL.items()) + f" from (select doc_id, {SEQ} as s from documents)")
def validate_dna(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", iupac(T).alias("s"))
    return base.select("doc_id", *[c for k in VALID for c in (sq.is_valid_dna(F.col("s"), k).alias(k), F.length(sq.retain_dna(F.col("s"), k)).cast("bigint").alias(f"kept_{k}"))])


def _sql_map(kept: str | None, rest: str, old: str, new: str) -> str:
    """What is not of the class ``kept`` becomes ``rest``; then letters are exchanged."""
    out = "s" if kept is None else f"regexp_replace(s, '[^{kept}]', '{rest}', 'g')"
    return f"translate({out}, '{old}', '{new}')"


_ANY, _IUPAC = "ACGTUNacgtun", "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
_LOW, _HIGH = "acgtnuU", "ACGTNTT"
_LOW_I, _HIGH_I = "acgturyswkmbdhvnU", "ACGTTRYSWKMBDHVNT"
_DOUBT = "RYSWKMBDHVryswkmbdhv"
#: Maps, stated again for SQL: the class that is kept (none: all), what the rest becomes, and the letters exchanged.
_RECODE_SQL = {
    "iupac_to_acgtn_with_gaps": (None, "", "Uu" + _DOUBT, "Tt" + "N" * 10 + "n" * 10),
    "iupac_to_acgtn_with_gaps_upper": (None, "", _LOW + _DOUBT, _HIGH + "N" * 20),
    "any_to_acgtn_no_gaps_upper": (_ANY, "N", _LOW, _HIGH),
    "any_to_acgtn_with_gaps_upper": (_ANY + ".-", "N", _LOW, _HIGH),
    "any_to_iupac_with_gaps": (_IUPAC + ".-", "N", "Uu", "Tt"),
    "any_to_iupac_with_gaps_upper": (_IUPAC + ".-", "N", _LOW_I, _HIGH_I),
    "any_to_iupac_correct_gaps_upper": (_IUPAC + ".:~-", "N", _LOW_I + ":~", _HIGH_I + "--"),
    "to_rna": ("ACGUNTacgunt", "N", "Tt", "Uu"),
    "to_rna_upper": ("ACGUTacgut", "N", "Tacgut", "UACGUU"),
    "any_to_acgtn_no_gaps": (_ANY, "N", "Uu", "Tt"),
    "any_to_acgtn_with_gaps": (_ANY + ".-", "N", "Uu", "Tt"),
    "any_to_iupac_no_gaps": (_IUPAC, "N", "Uu", "Tt"),
    "any_to_iupac_no_gaps_upper": (_IUPAC, "N", _LOW_I, _HIGH_I),
}
_REFINE_SQL = {
    "iupac_no_gaps_uc": (_IUPAC, "", _LOW_I, _HIGH_I),
    "iupac_with_gaps_uc": (_IUPAC + ".-", "", _LOW_I, _HIGH_I),
    "iupac_correct_gaps_uc": (_IUPAC + ".:~-", "", _LOW_I + ":~", _HIGH_I + "--"),
    "acgtn_no_gaps_uc": (_ANY, "", _LOW, _HIGH),
    "acgtn_with_gaps_uc": (_ANY + ".-", "", _LOW, _HIGH),
    "acgtn_std_gaps_uc": (_ANY + ".:~-", "", _LOW + ".:~", _HIGH + "---"),
    "acgt_no_gaps_uc": ("ACGTUacgtu", "", "acgtuU", "ACGTTT"),
}


@query("select doc_id, " + ", ".join(f"md5({_sql_map(*m)}) as {k}" for k, m in _RECODE_SQL.items()) + f" from (select doc_id, regexp_replace(coalesce(text, ''), '[^ -~]+', '', 'g') as s from documents)")
def recode_dna(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce(F.col(T), F.lit("")), "[^ -~]+", "").alias("s"))
    return base.select("doc_id", *[F.md5(sq.recode_dna(F.col("s"), k)).alias(k) for k in RECODE])


@query("select doc_id, " + ", ".join(f"md5({_sql_map(*m)}) as {k}" for k, m in _REFINE_SQL.items()) + f" from (select doc_id, {SEQ} as s from documents)")
def refine_dna(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", iupac(T).alias("s"))
    return base.select("doc_id", *[F.md5(sq.retain_and_recode_dna(F.col("s"), k)).alias(k) for k in REFINE])


# Scalars ----------------------------------------------------------------------------------------------------------------


@query(
    "select doc_id, md5(reverse(translate(s, 'GCATRYKMBVDHUgcatrykmbvdhu', 'CGTAYRMKVBHDAcgtayrmkvbhda'))) as reverse_complement, md5(substring(s, 1, 30)) as shortened, case when length(s) >= 10 then md5(substring(s, 11)) end as cut, "
    "case when length(s) >= 20 then substring(s, 6, 15) end as slice, md5(case when length(s) >= 20 then substring(s, 1, 5) || repeat('N', 15) || substring(s, 21) else s end) as masked, md5('NN' || s || 'NNN') as padded, "
    "length(s) // 3 as n_codons, case when length(s) >= 6 then substring(s, 4, 3) end as second_codon, case when length(s) >= 3 then substring(s, (length(s) // 3 - 1) * 3 + 1, 3) end as last_codon, case when length(s) >= 3 then substring(s, length(s) - 2, 3) end as tail_codon, substring(s, length(s) - length(s) % 3 + 1, 3) as remainder "
    f"from (select doc_id, {DNA} as s from documents)"
)
def sequence_scalars(spark, sf_dir):
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return base.select("doc_id", F.md5(sq.reverse_complement(s)).alias("reverse_complement"), F.md5(sq.shorten_to(s, 30)).alias("shortened"), F.md5(sq.cut_to_start(s, 10)).alias("cut"), sq.slice_range(s, 5, 20).alias("slice"), F.md5(sq.mask_if_exists(s, 5, 20)).alias("masked"), F.md5(sq.pad(s, "N", 2, 3)).alias("padded"), F.size(sq.codons(s)).cast("bigint").alias("n_codons"), sq.nth_codon(s, 1).alias("second_codon"), sq.last_codon(s).alias("last_codon"), sq.tail_codon(s).alias("tail_codon"), sq.codon_remainder(s).alias("remainder"))


@query("select p_partkey, p_name as id, p_brand as taxon from part where p_name <> '' and p_brand <> '' and position('{' in p_name) = 0")
def header_taxon(spark, sf_dir):
    head = F.concat("p_name", F.lit("{"), "p_brand", F.lit("}"))
    found = sq.id_taxon(head)
    return table(spark, sf_dir, "part").select("p_partkey", found["id"].alias("id"), found["taxon"].alias("taxon")).where("id is not null")


#: The standard code over ACGTN, stated again for SQL: each residue with its codons.
_CODONS = """A GCT GCC GCA GCG GCN; R CGT CGC CGA CGG CGN AGA AGG; N AAT AAC; D GAT GAC; C TGT TGC; Q CAA CAG; E GAA GAG;
G GGT GGC GGA GGG GGN; H CAT CAC; I ATT ATC ATA; L CTT CTC CTA CTG CTN TTA TTG; K AAA AAG; M ATG; F TTT TTC;
P CCT CCC CCA CCG CCN; S TCT TCC TCA TCG TCN AGT AGC; T ACT ACC ACA ACG ACN; W TGG; Y TAT TAC; V GTT GTC GTA GTG GTN;
* TAA TAG TGA; X NNN"""
_CODE = "map {" + ", ".join(f"'{codon}': '{part.split()[0]}'" for part in _CODONS.split(";") for codon in part.split()[1:]) + "}"
_AA = f"array_to_string([coalesce(({_CODE})[substring(s, 3 * i + 1, 3)], 'X') for i in range(0, length(s) // 3)], '')"
_OVER = f"array_to_string([coalesce(({_CODE})[substring(s, i + 1, 3)], 'X') for i in range(0, greatest(length(s) - 2, 0))], '')"


@query(
    "select doc_id, md5(t || case when length(s) % 3 > 0 then '~' else '' end) as translated, length(regexp_extract(t || case when length(s) % 3 > 0 then '~' else '' end, '^[^*]*\\*?', 0)) as to_stop, md5(o) as overlapping, "
    "nullif(position('M' in o), 0) - 1 as next_m, (nullif(position('M' in t), 0) - 1) * 3 as next_m_in_frame, nullif(position('ATG' in s), 0) - 1 as start_codon "
    f"from (select doc_id, s, {_AA} as t, {_OVER} as o from (select doc_id, {DNA} as s from documents))"
)
def translate(spark, sf_dir):
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return base.select("doc_id", F.md5(sq.translate(s)).alias("translated"), F.length(sq.translate_to_stop(s)).cast("bigint").alias("to_stop"), F.md5(sq.translate_overlapping(s)).alias("overlapping"), sq.find_next_aa(s, "M").cast("bigint").alias("next_m"), sq.find_next_aa_in_frame(s, "M").cast("bigint").alias("next_m_in_frame"), sq.find_start_codon(s)["start"].alias("start_codon"))


@query(
    "select codon, coalesce((" + _CODE + ")[codon], 'X') as aa, codon in ('TAA', 'TAG', 'TGA') as is_stop, substring(codon, 1, 1) in ('T', 'N') and substring(codon, 2, 1) in ('A', 'G', 'N') and substring(codon, 3, 1) in ('A', 'G', 'N') and (substring(codon, 2, 1) in ('A', 'N') or substring(codon, 3, 1) in ('A', 'N')) as maybe_stop, count(*) as n "
    f"from (select unnest([substring(s, 3 * i + 1, 3) for i in range(0, length(s) // 3)]) as codon from (select {DNA} as s from documents)) group by codon"
)
def codon_usage(spark, sf_dir):
    codons = table(spark, sf_dir, "documents").select(F.explode(sq.codons(dna(T))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    c = F.col("codon")
    return codons.select("codon", sq.translate_codon(c).alias("aa"), sq.is_std_stop_codon(c).alias("is_stop"), sq.maybe_std_stop_codon(c).alias("maybe_stop"), "n")


# Search -----------------------------------------------------------------------------------------------------------------


@query(
    "select doc_id, nullif(position('GATTA' in s), 0) - 1 as substring_start, position('CAT' in s) > 0 as has_cat, nullif(position('AAA' in s), 0) - 1 as run_of_three, "
    "case when length(regexp_extract(s, '^A*', 0)) >= 1 then length(regexp_extract(s, '^A*', 0)) end as run_at_start, case when length(regexp_extract(s, 'T*$', 0)) >= 1 then length(s) - length(regexp_extract(s, 'T*$', 0)) end as run_at_end, "
    "nullif(least(case when position('G' in s) = 0 then 1000000000 else position('G' in s) end, case when position('N' in s) = 0 then 1000000000 else position('N' in s) end), 1000000000) - 1 as byte2, "
    "md5(case when position('CAT' in s) = 0 then s else substring(s, 1, position('CAT' in s) - 1) || substring(s, position('CAT' in s) + 3) end) as removed, "
    "nullif(position('TA' in substring(s, 1, 50)), 0) - 1 as in_first, nullif(position('TA' in substring(s, greatest(length(s) - 50, 0) + 1)), 0) - 1 + greatest(length(s) - 50, 0) as in_last, case when length(s) >= 40 then nullif(position('TA' in substring(s, 11, 30)), 0) - 1 + 10 end as in_range "
    f"from (select doc_id, {DNA} as s from documents)"
)
def search(spark, sf_dir):
    s = F.col("s")
    find = lambda c: sq.find_substring(c, "TA")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return base.select("doc_id", sq.find_substring(s, "GATTA")["start"].alias("substring_start"), sq.contains_substring(s, "CAT").alias("has_cat"), sq.find_repeating(s, "A", 3)["start"].alias("run_of_three"), sq.find_repeating_at_start(s, "A", 1)["end"].alias("run_at_start"), sq.find_repeating_at_end(s, "T", 1)["start"].alias("run_at_end"), sq.find_byte(s, "GN").cast("bigint").alias("byte2"), F.md5(sq.remove_first_substring(s, "CAT")).alias("removed"), sq.search_in_first(s, 50, find)["start"].alias("in_first"), sq.search_in_last(s, 50, find)["start"].alias("in_last"), sq.search_in(s, 10, 40, find)["start"].alias("in_range"))


@query(f"select doc_id, list_min([i for i in range(0, greatest(length(s) - 9, 0)) if hamming(substring(s, i + 1, 10), 'TATTAGATTA') <= 2]) as start from (select doc_id, {DNA} as s from documents)")
def fuzzy_search(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return base.select("doc_id", sq.find_fuzzy(F.col("s"), "TATTAGATTA", 2)["start"].alias("start"))


@query(f"select doc_id, case when length(s) >= 12 then (length(s) - 12) // 5 + 1 else 0 end as n_windows, md5(array_to_string([substring(s, 5 * i + 1, 12) for i in range(0, case when length(s) >= 12 then (length(s) - 12) // 5 + 1 else 0 end)], ',')) as windows, nullif(substring(s, 1 + 5 * case when length(s) >= 12 then (length(s) - 12) // 5 + 1 else 0 end), '') as rest from (select doc_id, {DNA} as s from documents)")
def stepped_windows(spark, sf_dir):
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s")).withColumn("w", sq.stepped_windows(s, 12, 5))
    return base.select("doc_id", F.size("w").cast("bigint").alias("n_windows"), F.md5(F.array_join("w", ",")).alias("windows"), sq.final_partial_window(s, 12, 5).alias("rest"))


# Composition and quality -------------------------------------------------------------------------------------------------

_SLOT = {"a": "Aa", "c": "Cc", "g": "Gg", "t": "TtUu", "n": "Nn", "gap": "\\-", "other": "RYSWKMBDHVryswkmbdhv.", "invalid": None}
_COUNTS = ", ".join(f"length(regexp_replace(s, '[^{v}]+', '', 'g')) as {k}" if v else f"length(regexp_replace(s, '[{''.join(x for x in _SLOT.values() if x)}]+', '', 'g')) as invalid" for k, v in _SLOT.items())


@query(f"select doc_id, length(regexp_replace(s, '[^GCgc]+', '', 'g')) as gc_content, {_COUNTS} from (select doc_id, {SEQ} as s from documents)")
def base_counts(spark, sf_dir):
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", iupac(T).alias("s"))
    return base.select("doc_id", cp.gc_content(s).alias("gc_content"), cp.base_counts(s).alias("c")).select("doc_id", "gc_content", "c.*")


@query("select lang, " + ", ".join(f"cast(sum({k}) as bigint) as {k}" for k in _SLOT) + f", cast(sum(a + c + g + t) as bigint) as acgt from (select lang, {_COUNTS} from (select lang, {SEQ} as s from documents)) group by lang")
def base_counts_merged(spark, sf_dir):
    out = oc.merged_counts(table(spark, sf_dir, "documents").select("lang", iupac(T).alias("s")), "s", "lang")
    return out.withColumn("acgt", F.col("a") + F.col("c") + F.col("g") + F.col("t"))


_SITES = f"with s as (select item_id, {DNA} as s from benchmark), f as (select arg_min(length(s), item_id) as n from s), p as (select unnest(range(0, least(length(s), n))) as pos, s from s, f), c as (select pos, substring(s, pos + 1, 1) as b, count(*) as n from p group by 1, 2)"


@query(_SITES + ", t as (select pos, " + ", ".join(f"cast(coalesce(sum(n) filter (where b = '{x}'), 0) as bigint) as {x.lower()}" for x in "ACGTN") + " from c group by pos) select pos, a, c, g, t, n, case greatest(a, c, g, t, n) when a then 'A' when c then 'C' when g then 'G' when t then 'T' else 'N' end as base from t")
def per_site_consensus(spark, sf_dir):
    sites = oc.per_site_counts(table(spark, sf_dir, "benchmark").select("item_id", dna(T).alias("s")), "s", "item_id")
    return sites.select(F.col("pos").cast("bigint").alias("pos"), "a", "c", "g", "t", "n", cp.plurality_acgtn(F.struct(*[F.col(x) for x in cp.SLOTS])).alias("base"))


@query(
    "select doc_id, list_min(q) as min_q, list_max(q) as max_q, list_aggregate(q, 'median') as median_q, round(cast(cast(list_aggregate(q, 'avg') as float) as double), 4) as geometric_mean_q, round(cast(cast(-10 * log10(list_aggregate([pow(10, -x / 10.0) for x in q], 'avg')) as float) as double), 3) as arithmetic_mean_q "
    f"from (select doc_id, [ascii(x) - 33 for x in string_split({QUAL}, '')] as q from documents where length({QUAL}) > 0)"
)
def phred_statistics(spark, sf_dir):
    q = F.col("q")
    base = table(spark, sf_dir, "documents").select("doc_id", quality(T).alias("q")).where(F.length("q") > 0)
    return base.select("doc_id", cp.min_q(q).alias("min_q"), cp.max_q(q).alias("max_q"), cp.median_q(q).cast("double").alias("median_q"), F.round(cp.geometric_mean_q(q).cast("double"), 4).alias("geometric_mean_q"), F.round(cp.arithmetic_mean_q(q).cast("double"), 3).alias("arithmetic_mean_q"))


@query(f"select lang, count(*) as count, min(v) as min, quantile_cont(v, 0.5) as median, max(v) as max from (select lang, unnest([ascii(x) - 33 for x in string_split({QUAL}, '')]) as v from documents where length({QUAL}) > 0) where v between 0 and 93 group by lang")
def frequency_table(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("lang", F.explode(cp.phred(quality(T))).alias("v"))
    return oc.frequency_table(base, "v", "lang", low=0, high=93)


# Distances ---------------------------------------------------------------------------------------------------------------

_PAIRS = f"with d as (select doc_id, {DNA} as s from documents), p as (select a.doc_id, a.s as a, b.s as b, least(length(a.s), length(b.s)) as n from d a join d b on b.doc_id = a.doc_id + 1)"
_CELLS = [f"{x}{y}" for y in "ACGT" for x in "ACGT"]
_MATRIX = _PAIRS + ", c as (select doc_id, a, b, n, [substring(a, i + 1, 1) || substring(b, i + 1, 1) for i in range(0, n)] as z from p), m as (select doc_id, a, b, n, " + ", ".join(f"len([x for x in z if x = '{c}']) as m{c}" for c in _CELLS) + " from c), "
_MATRIX += "t as (select *, cast(" + " + ".join(f"m{c}" for c in _CELLS) + " as double) as total, " + " + ".join(f"m{c}" for c in _CELLS if c[0] != c[1]) + " as d, mAG + mGA as ag, mCT + mTC as ct, mAT + mTA + mCG + mGC as w1, mAC + mCA + mGT + mTG as w2 from m), "
_MATRIX += "f as (select *, case when total > 0 then d / total end as p, " + ", ".join(f"case when total > 0 then ({' + '.join(f'm{c}' for c in _CELLS if c[0] == x)} + {' + '.join(f'm{c}' for c in _CELLS if c[1] == x)}) / (2 * total) end as f{x}" for x in "ACGT") + " from t), "
_MATRIX += "g as (select *, 1 - fA * fA - fC * fC - fG * fG - fT * fT as e, fA + fG as r, fC + fT as y from f)"
_LN = lambda x: f"case when {x} > 0 then ln({x}) end"
_JC = _LN("1 - 4 * p / 3")
_K80A, _K80B = _LN("1 - 2 * (ag + ct) / nullif(total, 0) - (w1 + w2) / nullif(total, 0)"), _LN("1 - 2 * (w1 + w2) / nullif(total, 0)")
_K81 = _LN("(1 - 2 * (ag + ct) / nullif(total, 0) - 2 * w1 / nullif(total, 0)) * (1 - 2 * (ag + ct) / nullif(total, 0) - 2 * w2 / nullif(total, 0)) * (1 - 2 * w1 / nullif(total, 0) - 2 * w2 / nullif(total, 0))")
_F81 = _LN("1 - p / nullif(e, 0)")
_TN = "(2 * fA * fG / nullif(r, 0))", "(2 * fC * fT / nullif(y, 0))", "(2 * (r * y - fA * fG * y / nullif(r, 0) - fC * fT * r / nullif(y, 0)))"
_TN1, _TN2, _TN3 = _LN(f"(1 - (ag / nullif(total, 0)) / nullif({_TN[0]}, 0) - ((w1 + w2) / nullif(total, 0)) / nullif(2 * r, 0))"), _LN(f"(1 - (ct / nullif(total, 0)) / nullif({_TN[1]}, 0) - ((w1 + w2) / nullif(total, 0)) / nullif(2 * y, 0))"), _LN("(1 - ((w1 + w2) / nullif(total, 0)) / nullif(2 * r * y, 0))")


@query(
    _MATRIX + " select doc_id, hamming(substring(a, 1, n), substring(b, 1, n)) as hamming, cast(d as bigint) as matrix_hamming, round(p, 9) as p_distance, "
    f"round(-0.75 * ({_JC}) + 0.0, 9) as jc69, round(-0.5 * ({_K80A}) - 0.25 * ({_K80B}) + 0.0, 9) as k80, round(-0.25 * ({_K81}) + 0.0, 9) as k81, round(-e * ({_F81}) + 0.0, 9) as f81, round(-{_TN[0]} * ({_TN1}) - {_TN[1]} * ({_TN2}) - {_TN[2]} * ({_TN3}) + 0.0, 9) as tn93 from g"
)
def dna_distances(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    pairs = base.select("doc_id", F.col("s").alias("a")).join(base.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b")), "doc_id")
    pairs = pairs.select("doc_id", ds.hamming(F.col("a"), F.col("b")).alias("hamming"), ds.substitution_matrix(F.col("a"), F.col("b")).alias("m"))
    m = ds.Matrix(F.col("m"))
    r = lambda x: F.round(x, 9)
    return pairs.select("doc_id", "hamming", m.hamming().alias("matrix_hamming"), r(m.p_distance()).alias("p_distance"), r(m.jc69()).alias("jc69"), r(m.k80()).alias("k80"), r(m.k81()).alias("k81"), r(m.f81()).alias("f81"), r(m.tn93()).alias("tn93"))


_FACTORS = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in ds.FACTORS.items() if k in AMINO_ACIDS)


@query(
    f"with d as (select item_id, {AA} as s from benchmark), p as (select a.item_id, a.s as a, b.s as b, unnest(range(0, least(length(a.s), length(b.s)))) as i from d a join d b on b.item_id = a.item_id + 1), f(l, f1, f2, f3, f4, f5) as (values {_FACTORS}) "
    "select item_id, round(avg(case when x.l = y.l then 0 else sqrt(pow(x.f1 - y.f1, 2) + pow(x.f2 - y.f2, 2) + pow(x.f3 - y.f3, 2) + pow(x.f4 - y.f4, 2) + pow(x.f5 - y.f5, 2)) end), 3) as distance from p join f x on x.l = substring(a, i + 1, 1) join f y on y.l = substring(b, i + 1, 1) group by item_id"
)
def protein_distance(spark, sf_dir):
    base = table(spark, sf_dir, "benchmark").select("item_id", residues(T).alias("s"))
    pairs = base.select("item_id", F.col("s").alias("a")).join(base.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("b")), "item_id")
    return pairs.select("item_id", F.round(ds.physiochemical(F.col("a"), F.col("b"))["distance"].cast("double"), 3).alias("distance")).where("distance is not null")


# CIGAR and SAM -----------------------------------------------------------------------------------------------------------

_CIGAR = "cast(l_linenumber as varchar) || 'S' || cast(cast(l_quantity as int) as varchar) || 'M2I' || cast(l_linenumber as varchar) || 'D3M4N1='"


def _with_cigar(spark, sf_dir):
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M2I"), F.col("l_linenumber").cast("string"), F.lit("D3M4N1="))
    return table(spark, sf_dir, "lineitem").withColumn("cigar", text)


@query(
    f"select l_orderkey, l_linenumber, cigar, regexp_full_match(cigar, '([1-9][0-9]*[MIDNSHP=X])*') as valid, cast(l_quantity as int) + l_linenumber + 8 as ref_len, l_linenumber + cast(l_quantity as int) + 6 as query_len, regexp_matches(cigar, '[ID]') as indels, "
    "repeat('S', l_linenumber) || repeat('M', cast(l_quantity as int)) || 'II' || repeat('D', l_linenumber) || 'MMMNNNN=' as expanded, '1=4N3M' || cast(l_linenumber as varchar) || 'D2I' || cast(cast(l_quantity as int) as varchar) || 'M' || cast(l_linenumber as varchar) || 'S' as reversed "
    f"from (select *, {_CIGAR} as cigar from lineitem)"
)
def cigar_algebra(spark, sf_dir):
    c, ops = F.col("cigar"), F.col("ops")
    rows = _with_cigar(spark, sf_dir).select("l_orderkey", "l_linenumber", "cigar", cg.ciglets(c).alias("ops"))
    return rows.select("l_orderkey", "l_linenumber", "cigar", cg.is_valid(c).alias("valid"), cg.ref_len(ops, True).alias("ref_len"), cg.query_len(ops, True).alias("query_len"), cg.has_indels(ops, True).alias("indels"), cg.expanded(ops, True).alias("expanded"), cg.reversed_cigar(ops, True).alias("reversed"))


def _sam(spark, sf_dir):
    base = _with_cigar(spark, sf_dir)
    seq = F.repeat(F.lit("A"), F.col("l_linenumber") + F.col("l_quantity").cast("int") + 6)
    return base.select(F.col("l_orderkey").cast("string").alias("qname"), F.lit(0).alias("flag"), F.when(F.col("l_returnflag") == "R", "*").otherwise(F.col("l_returnflag")).alias("rname"), F.col("l_partkey").alias("pos"), F.lit(60).cast("smallint").alias("mapq"), "cigar", F.lit("*").alias("rnext"), F.lit(0).cast("bigint").alias("pnext"), F.lit(0).alias("tlen"), seq.alias("seq"), F.lit("").alias("qual"))


_SAM = f"select cast(l_orderkey as varchar) as qname, case when l_returnflag = 'R' then '*' else l_returnflag end as rname, l_partkey as pos, {_CIGAR} as cigar, repeat('A', l_linenumber + cast(l_quantity as int) + 6) as seq, l_linenumber, cast(l_quantity as int) as q from lineitem"


@query(f"select qname, rname, pos, cigar, case when rname = 'N' then 0 when rname = '*' then 2 else 1 end as class from ({_SAM})")
def sam_coordinate_sort(spark, sf_dir):
    order = spark.createDataFrame([("N", 0)], "rname string, idx int")
    kind = F.when(F.col("rname") == "*", 2).when(F.col("rname") == "N", 0).otherwise(1)
    return sm.coordinate_sort(_sam(spark, sf_dir), order).select("qname", "rname", "pos", "cigar", kind.alias("class"))


@query(f"select qname, pos, cigar, pos - 1 as ref_start, pos - 1 + q + l_linenumber + 8 as ref_end, l_linenumber as query_start, length(seq) as query_end, length(seq) as query_len from ({_SAM})")
def sam_to_alignment(spark, sf_dir):
    a = sm.to_alignment(F.col("flag"), F.col("pos"), F.col("cigar"), F.col("seq"), F.lit(1).cast("bigint"), F.lit(1000).cast("bigint"))
    return _sam(spark, sf_dir).select("qname", "pos", "cigar", a.alias("a")).select("qname", "pos", "cigar", "a.ref_start", "a.ref_end", "a.query_start", "a.query_end", "a.query_len")


@query(f"select qname || chr(9) || '0' || chr(9) || rname || chr(9) || cast(pos as varchar) || chr(9) || '60' || chr(9) || cigar || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || '*' as line from ({_SAM})")
def sam_text(spark, sf_dir):
    records = _sam(spark, sf_dir)
    return records.select(sam_line({c: F.col(c) for c in records.columns}).alias("line"))


@query(f"select doc_id, '>doc' || cast(doc_id as varchar) || chr(10) || {DNA} as fasta, case when length({QUAL}) > 0 then '@doc' || cast(doc_id as varchar) || chr(10) || repeat('N', length({QUAL})) || chr(10) || '+' || chr(10) || {QUAL} end as fastq from documents")
def record_text(spark, sf_dir):
    q = quality(T)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", fasta_line(name, dna(T)).alias("fasta"), F.when(F.length(q) > 0, fastq_line(name, F.repeat(F.lit("N"), F.length(q)), q)).alias("fastq"))


# Alignment: tested against literal recurrences, as SQL has no dynamic programming ----------------------------------------


def _item_pairs(spark, sf_dir):
    base = table(spark, sf_dir, "benchmark").select("item_id", dna(T).alias("s"))
    return base.select("item_id", F.col("s").alias("ref")).join(base.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("query")), "item_id")


@query()
def align_local(spark, sf_dir):
    a = al.align(F.col("ref"), F.col("query"), al.Weights.dna(2, -5), -10, -1)
    return _item_pairs(spark, sf_dir).select("item_id", a.alias("a")).select("item_id", "a.*")


@query()
def align_local_banded(spark, sf_dir):
    a = al.align(F.col("ref"), F.col("query"), al.Weights.dna(2, -5), -10, -1, band=20)
    return _item_pairs(spark, sf_dir).select("item_id", a.alias("a")).select("item_id", "a.*")


@query()
def align_global(spark, sf_dir):
    a = al.align(F.col("ref"), F.col("query"), al.Weights.dna(4, -2), -3, -1, mode="global")
    return _item_pairs(spark, sf_dir).select("item_id", a.alias("a")).select("item_id", "a.*")


@query()
def align_scores(spark, sf_dir):
    w = al.Weights.dna(2, -5)
    return _item_pairs(spark, sf_dir).select("item_id", al.score(F.col("ref"), F.col("query"), w, -10, -1).alias("local"), al.score(F.col("ref"), F.col("query"), w, -10, -1, "global").alias("global"), al.pre_filter(F.col("ref"), F.col("query"), 0.9).alias("may_align"))
