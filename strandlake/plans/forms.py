"""Further queries: readers and writers, builders and short forms, alignment, CIGAR and SAM algebra, samplers, profile HMMs.

Their SQL states letters, tables and scores as literals of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions import composition as cp
from strandlake.functions import sequence as sq
from strandlake.functions.alphabets import DNA_PROFILE, ByteMap, Validator
from strandlake.operators import alignment as al
from strandlake.operators import generate as ge
from strandlake.operators import kmers as km
from strandlake.operators import phmm
from strandlake.operators import sam as sm
from strandlake.operators import sampling as sp
from strandlake.operators import trimming as tr
from strandlake.plans.queries import DNA, QUAL, SEQ, T, _sam, dealt, dna, iupac, quality, query, table
from strandlake.sources import fasta, fastq, sam
from strandlake.sources.scratch import scratch

# Readers and writers ----------------------------------------------------------------------------------------------------------


@query(f"select 'doc' || cast(doc_id as varchar) as name, lang as taxon, md5(s) as sequence from (select doc_id, lang, {DNA} as s from documents) where s <> ''")
def fasta_files(spark, sf_dir):
    """Documents as FASTA records with a taxon in their headers, written and read back."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("{"), "lang", F.lit("}")).alias("name"), dna(T).alias("sequence")).where("sequence <> ''")
    path = scratch(spark)
    fasta.write_fasta(rows, path)
    return fasta.annotated(fasta.read_fasta(spark, path)).select("name", "taxon", F.md5("sequence").alias("sequence"))


@query(f"select 'doc' || cast(doc_id as varchar) as header, md5(translate(reverse(repeat('ACGTN', (length(q) + 4) // 5)[1 : length(q)]), 'ACGT', 'TGCA')) as sequence, md5(reverse(q)) as quality from (select doc_id, {QUAL} as q from documents) where q <> ''")
def fastq_files(spark, sf_dir):
    """Documents as FASTQ records, written, read back and turned."""
    q = quality(T)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("header"), q.alias("quality")).where("quality <> ''")
    rows = rows.withColumn("sequence", F.substring(F.repeat(F.lit("ACGTN"), F.ceil(F.length("quality") / 5).cast("int")), F.lit(1), F.length("quality")))
    path = scratch(spark)
    fastq.write_fastq(rows, path)
    return fastq.reverse_complement(fastq.read_fastq(spark, path)).select("header", F.md5("sequence").alias("sequence"), F.md5("quality").alias("quality"))


_LINES = "select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int) as q, l_returnflag from lineitem"


def _tagged(spark, sf_dir):
    number = F.col("pos").cast("string")
    tags = F.array(F.concat(F.lit("AS:i:"), number), F.concat(F.lit("NM:Z:n"), number), F.lit("XA:A:!"), F.lit("XF:f:1.5"), F.lit("XH:H:0aFF"), F.concat(F.lit("XB:B:c,1,-"), number))
    return _sam(spark, sf_dir).withColumn("opt_fields", tags)


@query(
    f"select cast(l_orderkey as varchar) as qname, l_partkey as pos, cast(l_linenumber as varchar) || 'S' || cast(q as varchar) || 'M2I' || cast(l_linenumber as varchar) || 'D3M4N1=' as cigar, l_linenumber + q + 6 as seq_len, '' as qual, '*' as rnext, "
    f"l_partkey as score, 'n' || cast(l_partkey as varchar) as nm, '!' as one, 1.5 as f, '0AFF' as h, 'c' as subtype, 1.0 - l_partkey as arr_sum, false as unmapped, case when l_returnflag = 'N' then 0 when l_returnflag = 'A' then 1 end as idx from ({_LINES})"
)
def sam_files(spark, sf_dir):
    """Line items as SAM records with optional fields under a header, written and read back, with their references' places."""
    header = spark.createDataFrame([("@HD\tVN:1.5", 0), ("@SQ\tSN:N\tLN:100", 1), ("@SQ\tLN:9\tSN:A", 2)], "line string, idx int")
    path = scratch(spark)
    sam.write_sam(_tagged(spark, sf_dir), path, sam.sorted_header(header))
    order = sam.reference_order(sam.read_sam_header(spark, path))
    rows = sam.read_sam(spark, path).join(F.broadcast(order.withColumn("idx", F.col("idx") - 1)), "rname", "left")
    get = lambda tag: sm.typed(sm.optional(F.col("opt_fields"), tag))
    arr = F.aggregate(get("XB")["arr"], F.lit(0.0), lambda a, x: a + x)
    return rows.select("qname", "pos", "cigar", F.length("seq").alias("seq_len"), "qual", "rnext", get("AS")["int"].alias("score"), get("NM")["string"].alias("nm"), get("XA")["char"].alias("one"), get("XF")["float"].cast("double").alias("f"), get("XH")["string"].alias("h"), get("XB")["subtype"].alias("subtype"), arr.alias("arr_sum"), sm.is_unmapped(F.col("flag"), F.col("cigar")).alias("unmapped"), "idx")


@query(
    f"select qname, rname, pos, cigar, flag, mapq, seq_len, opt, missing from (select cast(l_orderkey as varchar) as qname, l_returnflag as rname, cast(l_partkey as bigint) as pos, cast(q as varchar) || 'M' as cigar, 16 as flag, 60 as mapq, q as seq_len, 'AS:i:' || cast(2 * q as varchar) as opt, false as missing from ({_LINES}) where l_linenumber > 1 "
    f"union all select cast(l_orderkey as varchar), l_returnflag, 0, '', 4, 255, 1, null, true from ({_LINES}) where l_linenumber = 1)"
)
def sam_constructors(spark, sf_dir):
    """Records made of alignments, and unmapped ones."""
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("int"))
    a = F.struct((F.col("n") * 2).cast("bigint").alias("score"), (F.col("l_partkey") - 1).alias("ref_start"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"))
    made = sm.from_alignment(a, F.col("l_orderkey").cast("string"), F.col("l_returnflag"), F.repeat(F.lit("A"), F.col("n")), F.lit("*"), mapq=60, flag=16)
    some = rows.where("l_linenumber > 1").select(made.alias("r")).select("r.*").withColumn("opt", F.get("opt_fields", F.lit(0)))
    none = rows.where("l_linenumber = 1").select(*sm.unmapped(F.col("l_orderkey").cast("string"), F.col("l_returnflag"))).withColumn("opt", F.lit(None).cast("string"))
    out = some.select(*none.columns).unionByName(none)
    return out.select("qname", "rname", "pos", "cigar", "flag", F.col("mapq").cast("int").alias("mapq"), F.length("seq").alias("seq_len"), "opt", sm.is_missing(F.col("seq")).alias("missing"))


@query(f"select class, pos, qname, min(place) as place from (select class, pos, qname, rank() over (order by class, pos, qname) as place from (select case when l_returnflag = 'N' then 0 when l_returnflag = 'R' then 2 else 1 end as class, l_partkey as pos, cast(l_orderkey as varchar) as qname from ({_LINES}))) group by class, pos, qname")
def sam_sorted_places(spark, sf_dir):
    """The place of each record in the sorted table (of equal ones the first): counts of the parts before and the place in its part."""
    order = spark.createDataFrame([("N", 0)], "rname string, idx int")
    path = scratch(spark)
    at = F.monotonically_increasing_id()
    spread = sm.coordinate_sort(_sam(spark, sf_dir), order).select("rname", "pos", "qname", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("i"))
    spread.write.parquet(path)
    rows = spark.read.parquet(path)
    parts, before, total = sorted(tuple(r) for r in rows.groupBy("part").count().collect()), {}, 0
    for p, n in parts:
        before[p], total = total, total + n
    start = spark.createDataFrame(list(before.items()), "part int, before bigint")
    kind = F.when(F.col("rname") == "*", 2).when(F.col("rname") == "N", 0).otherwise(1)
    return rows.join(F.broadcast(start), "part").select(kind.alias("class"), "pos", "qname", (F.col("before") + F.col("i") + 1).alias("place")).groupBy("class", "pos", "qname").agg(F.min("place").alias("place"))


# Builders and short forms -------------------------------------------------------------------------------------------------------


@query(
    "select doc_id, regexp_full_match(s, '[ACGTN]*') as acgtn_uc, regexp_full_match(t, '[\\x00-\\x7F]*') as ascii, regexp_full_match(t, '[!-~]*') as graphic, length(regexp_replace(t, '[^a-mX]+', '', 'g')) as built, "
    "left(s, 1) in ('A', 'C', 'G', 'T', 'N') as first_valid, case when left(t, 1) in ('A','C','G','T','U','N','a','c','g','t','u','n') then replace(upper(left(t, 1)), 'U', 'T') end as first_refined, case when left(i, 1) in ('A','a','R','r','W','w','M','m','D','d','H','h','V','v','N','n','G','g','S','s','K','k','B','b') then true else false end as maybe_ag "
    f"from (select doc_id, {DNA} as s, {SEQ} as i, coalesce(text, '') as t from documents)"
)
def byte_checks(spark, sf_dir):
    """Whole-sequence and single-letter checks, and a class built by ranges."""
    built = Validator().add_range("a", "m").add("XY").remove("Y").remove_range("n", "z")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"), iupac(T).alias("i"), F.coalesce(F.col(T), F.lit("")).alias("t"))
    first = lambda c: F.substring(c, 1, 1)
    valid = F.when(F.length("s") > 0, sq.is_valid_dna(first("s"), "acgtn_no_gaps")).otherwise(F.lit(False))
    refined = F.when(F.length("t") > 0, sq.refine_base(first("t"), "acgtn_no_gaps_uc"))
    return base.select("doc_id", sq.is_acgtn_uc(F.col("s")).alias("acgtn_uc"), sq.is_ascii(F.col("t")).alias("ascii"), sq.is_graphic(F.col("t")).alias("graphic"), F.length(built.retain(F.col("t"))).alias("built"), valid.alias("first_valid"), refined.alias("first_refined"), sq.maybe_base(first("i"), "AG").alias("maybe_ag"))


@query(
    "select doc_id, md5(replace(upper(regexp_replace(i, '[^ACGTUNacgtun]', 'N', 'g')), 'U', 'T')) as reads, md5(translate(regexp_replace(upper(i), '[^ACGTURYSWKMBDHVN.:~-]', 'N', 'g'), 'U:~', 'T--')) as aligned, md5(translate(upper(i), 'U:~', 'T--')) as filtered, md5(translate(upper(regexp_replace(i, '[.:~-]+', '', 'g')), 'U', 'T')) as unaligned, "
    "md5(upper(i)) as upper, md5(replace(i, 'a', 'x')) as replaced, md5(regexp_replace(translate(i, 'abcdXYZ', 'bcde***'), '[^b-e*Gg]', '?', 'g')) as mapped "
    f"from (select doc_id, {SEQ} as i from documents)"
)
def recoding_forms(spark, sf_dir):
    """The shorthands, and a map built by ranges with a default."""
    i = F.col("i")
    built = ByteMap("?").map_range("a", "d", "b").map_to_one("XYZ", "*").preserve("bcde*Gg").map("abcd", "bcde")
    forms = {"reads": sq.recode_dna_reads(i), "aligned": sq.recode_dna_aligned(i), "filtered": sq.filter_to_dna(i), "unaligned": sq.filter_to_dna_unaligned(i), "upper": sq.make_uppercase(i), "replaced": sq.replace_all_bytes(i, "a", "x"), "mapped": built.apply(i)}
    return table(spark, sf_dir, "documents").select("doc_id", iupac(T).alias("i")).select("doc_id", *[F.md5(v).alias(k) for k, v in forms.items()])


@query(
    "select doc_id, starts_with(s, 'GA') as starts, ends_with(s, 'TT') as ends, length(s) as n, substring(s, 3, 1) as third, md5('AC' || s || 'GT') as joined, md5(regexp_replace(t, '[\\r\\n]+', '', 'g')) as one_line, regexp_replace(substring(s, 1, 3) || '*', '\\*$', '') as chopped, "
    "nullif(position('CA' in translate(s, 'GT', 'CA')), 0) - 1 as mapped, nullif(regexp_replace(s, '^[^GT]*', ''), '') is null as no_gt, case when length(regexp_extract(s, '^[^GT]*', 0)) < length(s) then length(regexp_extract(s, '^[^GT]*', 0)) end as first_gt, "
    "case when position('C' in s) > 0 then length(s) - position('C' in reverse(s)) end as last_c, nullif(position('ATG' in s), 0) + 2 as start_end "
    f"from (select doc_id, {DNA} as s, coalesce(text, '') as t from documents)"
)
def sequence_forms(spark, sf_dir):
    """String forms of sequences, mapped search, and positions by a predicate."""
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"), F.coalesce(F.col(T), F.lit("")).alias("t"))
    gt = sq.position(s, pattern="[GT]")
    return base.select("doc_id", F.startswith("s", F.lit("GA")).alias("starts"), F.endswith("s", F.lit("TT")).alias("ends"), F.length("s").alias("n"), F.substring("s", 3, 1).alias("third"), F.md5(F.concat(F.lit("AC"), "s", F.lit("GT"))).alias("joined"), F.md5(sq.strip_line_breaks(F.col("t"))).alias("one_line"), sq.chop_stop(F.concat(F.substring("s", 1, 3), F.lit("*"))).alias("chopped"), sq.find_mapped(s, "CA", ByteMap().map("GT", "CA"))["start"].alias("mapped"), gt.isNull().alias("no_gt"), gt.alias("first_gt"), sq.last_position(s, "C").alias("last_c"), sq.find_start_codon(s)["end"].alias("start_end"))


@query(
    "select doc_id, [length(regexp_replace(s, '[^A]+', '', 'g')), length(regexp_replace(s, '[^C]+', '', 'g')), length(regexp_replace(s, '[^G]+', '', 'g')), length(regexp_replace(s, '[^T]+', '', 'g')), length(regexp_replace(s, '[ACGT]+', '', 'g'))] as counts, position(left(s, 1) in 'ACGTN') - 1 as index, "
    "(select sum(length(x)) from (select unnest(regexp_extract_all(s, 'ATG')) as x)) // 3 as n_start from "
    f"(select doc_id, {DNA} as s from documents) where s <> ''"
)
def byte_index_counts(spark, sf_dir):
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s")).where("s <> ''")
    starts = F.size(F.regexp_extract_all("s", F.lit("ATG"), F.lit(0)))
    return base.select("doc_id", DNA_PROFILE.counts(s).alias("counts"), DNA_PROFILE.to_index(F.substring("s", 1, 1)).alias("index"), F.when(starts > 0, starts).alias("n_start"))


_REGIONS = (
    "with recursive u as (select doc_id, s, q from ("
    f"select doc_id, {DNA} as s, {QUAL} as q from documents) where length(q) > 0), "
    # each step takes what lies before the next start codon and the region behind it off the rest
    "step(doc_id, rest, regions, coding, non_coding, coding_bases, non_coding_bases) as (select doc_id, s, 0, '', '', 0, 0 from u union all "
    "select doc_id, case when stop is null then '' else substring(after, stop + 3) end, regions + 1, coding || case when stop is null then after else substring(after, 1, stop - 1) end, non_coding || before, 0, 0 from "
    "(select doc_id, regions, coding, non_coding, before, after, list_min([i for i in range(1, length(after) - 1, 3) if substring(after, i, 3) in ('TAA', 'TAG', 'TGA')]) as stop from "
    "(select doc_id, regions, coding, non_coding, substring(rest, 1, position('ATG' in rest) - 1) as before, substring(rest, position('ATG' in rest) + 3) as after from step where position('ATG' in rest) > 0))), "
    "ends as (select doc_id, regions, coding, non_coding || rest as non_coding from step where position('ATG' in rest) = 0) "
)


@query(
    _REGIONS + "select u.doc_id as doc_id, length(s) as bases, regions, length(regexp_replace(coding, '[^GC]+', '', 'g')) as coding, length(regexp_replace(non_coding, '[^GC]+', '', 'g')) as non_coding, length(coding) as coding_bases, length(non_coding) as non_coding_bases, md5(coding) as coding_md5 from u join ends on ends.doc_id = u.doc_id"
)
def coding_regions(spark, sf_dir):
    """G and C inside and outside all coding regions, which a start codon begins and a stop in its frame or the sequence ends."""
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"), quality(T).alias("q")).where("q <> ''")
    gc, regions = cp.coding_gc(s), cp.coding_regions(s)
    inside = F.array_join(F.transform(regions, lambda r: r["bases"]), "")
    return base.select("doc_id", F.length("s").alias("bases"), F.size(regions).alias("regions"), *[gc[c].alias(c) for c in ("coding", "non_coding", "coding_bases", "non_coding_bases")], F.md5(inside).alias("coding_md5"))


@query(
    _REGIONS + ", p as (select doc_id, cast(ascii(substring(u.q, 1, 1)) - 33 as double) as x, list_min([ascii(c) - 33 for c in string_split(u.q, '')]) as q_min, list_max([ascii(c) - 33 for c in string_split(u.q, '')]) as q_max from u) "
    "select u.doc_id as doc_id, length(s) as bases, length(regexp_replace(coding, '[^GC]+', '', 'g')) as coding, length(regexp_replace(non_coding, '[^GC]+', '', 'g')) as non_coding, round(cast(cast(pow(10, -x / 10.0) as float) as double), 9) as error, round(x, 3) as q_again, q_min, q_max from u join ends on ends.doc_id = u.doc_id join p on p.doc_id = u.doc_id"
)
def composition_forms(spark, sf_dir):
    """G and C inside and outside coding regions, Phred conversions there and back, and the ends of the scores' range."""
    s, q = F.col("s"), F.col("q")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"), quality(T).alias("q")).where("q <> ''")
    first = (F.ascii(F.substring(q, 1, 1)) - 33).cast("double")
    mm, gc = cp.min_median_max(q), cp.coding_gc(s)
    return base.select("doc_id", F.length("s").alias("bases"), gc["coding"].alias("coding"), gc["non_coding"].alias("non_coding"), F.round(cp.error_of_q(first).cast("double"), 9).alias("error"), F.round(cp.q_of_error(cp.error_of_q(first)).cast("double"), 3).alias("q_again"), mm["min"].alias("q_min"), mm["max"].alias("q_max"))


# K-mers and trimming --------------------------------------------------------------------------------------------------------------


@query(
    f"with p as (select distinct substring(s, i + 1, 9) as kmer from (select s, unnest(range(0, greatest(length(s) - 8, 0))) as i from (select {DNA} as s from benchmark))), w as (select doc_id, unnest(range(0, greatest(length(s) - 8, 0))) as pos, s from (select doc_id, {DNA} as s from documents)) "
    "select doc_id, min(pos) as first_start, max(pos) as last_start, max(pos) + 9 as last_end from w join p on substring(s, pos + 1, 9) = kmer group by doc_id"
)
def kmer_first_and_last(spark, sf_dir):
    probe = km.kmer_set(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 9)
    docs = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return km.find_ends(docs, "doc_id", "s", probe, 9)


@query(f"select item_id, pos, kmer, kmer as decoded, cast(list_sum([case substring(kmer, i, 1) when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end * (cast(1 as bigint) << (2 * (40 - i))) for i in range(10, 41)]) as bigint) % 4611686018427387904 as low_part from (select item_id, unnest(range(0, length(s) - 39)) as pos, substring(s, pos + 1, 40) as kmer from (select item_id, replace({DNA}, 'N', 'A') as s from benchmark))")
def kmer_wide_encoding(spark, sf_dir):
    rows = km.kmers(table(spark, sf_dir, "benchmark").select("item_id", dna(T).alias("s")), "s", 40, bits=2, keep=("item_id",))
    code = km.encode_wide(F.col("kmer"), 2)
    return rows.select("item_id", F.col("pos").cast("bigint").alias("pos"), "kmer", km.decode_wide(code, 40, 2).alias("decoded"), code["low"].bitwiseAND((1 << 62) - 1).alias("low_part"))


_PRIMER = "TATTAGATTATA"


@query(
    f"with r as (select doc_id, {DNA} as s from documents where length({DNA}) > 0), a as (select doc_id, s, length(regexp_extract(s, '^A*', 0)) as x from r), b as (select doc_id, case when x >= 3 then substring(s, x + 1) else s end as s from a), c as (select doc_id, s, length(regexp_extract(s, 'A*$', 0)) as x from b), "
    "d as (select doc_id, case when x >= 3 then left(s, length(s) - x) else s end as s from c), e as (select doc_id, case when length(s) > 5 then substring(s, 3, length(s) - 5) else s end as s from d), "
    f"f as (select doc_id, s, list_max([i for i in range(0, greatest(least(length(s), 60) - 5, 0)) if substring(s, i + 1, 6) in ({', '.join(repr(_PRIMER[i : i + 6]) for i in range(7))})]) as k from e) select doc_id, md5(case when k is null then s else substring(s, k + 7) end) as sequence, length(case when k is null then s else substring(s, k + 7) end) as n from f"
)
def trimmed_reads(spark, sf_dir):
    """Runs of A at both ends, two and three bases, and a primer in the first sixty are trimmed."""
    reads = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("sequence")).where("sequence <> ''")
    steps = [tr.runs("A", 3), tr.hard(2, 3), tr.primer(tr.primer_kmers(_PRIMER, 6), 60)]
    return tr.trim(reads, steps, quality=None).select("doc_id", F.md5("sequence").alias("sequence"), F.length("sequence").alias("n"))


# Alignment ------------------------------------------------------------------------------------------------------------------------

#: Letters of names of parts and of their types, whole; short enough for a recurrence in SQL.
_A, _B = "regexp_replace(lower(p_name), '[^a-z]+', '', 'g')", "regexp_replace(lower(p_type), '[^a-z]+', '', 'g')"
_NO = -1000000


def _recurrence(mode: str, match: int, mismatch: int, go: int, ge_: int, band: int | None = None) -> str:
    """Affine-gap scores by antidiagonals d = i + j: lists over i of H for d - 1 and d - 2, and of both gap scores for d - 1."""
    local = mode == "local"
    edge = lambda k: "0" if local else f"(case when {k} = 0 then 0 else {go} + ({k} - 1) * {ge_} end)"
    w = f"(case when substring(a, i, 1) = substring(b, d + 1 - i, 1) then {match} else {mismatch} end)"
    inside = "i >= 1 and d + 1 - i >= 1 and d + 1 - i <= m" + (f" and abs(2 * i - d - 1) <= {band}" if band is not None else "")
    h = f"[case when {inside} then greatest(h2[i] + {w}, e[i + 1], f[i + 1]{', 0' if local else ''}) when d + 1 - i = 0 then {edge('i')} when i = 0 then {edge('(d + 1)')} else 0 end for i in range(0, n + 1)]"
    return (
        f"recursive p as (select p_partkey, {_A} as a, {_B} as b, length({_A}) as n, length({_B}) as m from part), "
        f"t as (select p_partkey, a, b, n, m, 0 as d, [{edge('0')} for i in range(0, n + 1)] as h, [0 for i in range(0, n + 1)] as h2, [{_NO} for i in range(0, n + 1)] as e, [{_NO} for i in range(0, n + 1)] as f, {{'s': 0, 'i': 0, 'j': 0}} as best, null::integer as whole from p where n > 0 and m > 0 "
        "union all select p_partkey, a, b, n, m, d + 1, hn, h, en, fn, "
        "greatest(best, list_max([{'s': hn[i + 1], 'i': -i, 'j': -(d + 1 - i)} for i in range(1, n + 1) if d + 1 - i between 1 and m] || [best])), case when d + 1 = n + m then hn[n + 1] end from "
        f"(select *, {h.replace('e[i + 1]', 'en[i + 1]').replace('f[i + 1]', 'fn[i + 1]')} as hn from (select *, "
        f"[case when i >= 1 and d + 1 - i >= 1 then greatest(e[i] + {ge_}, h[i] + {go}) else {_NO} end for i in range(0, n + 1)] as en, [case when d + 1 - i >= 1 then greatest(f[i + 1] + {ge_}, h[i + 1] + {go}) else {_NO} end for i in range(0, n + 1)] as fn from t where d < n + m)))"
    )


def _short_pairs(spark, sf_dir):
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", "")
    pairs = table(spark, sf_dir, "part").select("p_partkey", letters("p_name").alias("ref"), letters("p_type").alias("query")).where("ref <> '' and query <> ''")
    return dealt(pairs, "p_partkey")


_LATIN = "abcdefghijklmnopqrstuvwxyz"


@query(f"with {_recurrence('local', 3, -2, -3, -1)} select p_partkey, nullif(best.s, 0) as score, nullif(best.s, 0) as scored_path, nullif(best.s, 0) as three_pass, nullif(best.s, 0) as ranged, case when best.s > 0 then -best.i end as ref_end, case when best.s > 0 then -best.j end as query_end, case when best.s > 0 then -best.i end as ranged_ref_end, case when best.s > 0 then -best.j end as ranged_query_end, best.s > 0 as mapped from t where d = n + m")
def align_short_local(spark, sf_dir):
    """Local alignments of part names with part types by every way: score, whole matrix, path, ranges, three passes."""
    w, r, q = al.Weights.simple(_LATIN, 3, -2), F.col("ref"), F.col("query")
    pairs = _short_pairs(spark, sf_dir).withColumn("a", al.align(r, q, w, -3, -1)).withColumn("b", al.align(r, q, w, -3, -1, strategy="three_pass")).withColumn("c", al.score_ranges(r, q, w, -3, -1)).withColumn("score", al.score(r, q, w, -3, -1))
    pairs = pairs.withColumn("scored_path", al.path_score(r, q, F.col("a"), w, -3, -1)["score"])
    return pairs.select("p_partkey", "score", "scored_path", F.col("b.score").alias("three_pass"), F.col("c.score").alias("ranged"), F.col("a.ref_end").alias("ref_end"), F.col("a.query_end").alias("query_end"), F.col("c.ref_end").alias("ranged_ref_end"), F.col("c.query_end").alias("ranged_query_end"), (F.col("a.status") == "Some").alias("mapped"))


@query(f"with {_recurrence('local', 3, -2, -3, -1, 3)} select p_partkey, nullif(best.s, 0) as score from t where d = n + m")
def align_short_banded(spark, sf_dir):
    w = al.Weights.simple(_LATIN, 3, -2)
    return _short_pairs(spark, sf_dir).withColumn("a", al.align(F.col("ref"), F.col("query"), w, -3, -1, band=3)).select("p_partkey", F.col("a.score").alias("score"))


@query(f"with {_recurrence('global', 3, -2, -3, -1)} select p_partkey, whole as score, whole as scored_path, whole as aligned, n as ref_end, m as query_end from t where d = n + m")
def align_short_global(spark, sf_dir):
    w, r, q = al.Weights.simple(_LATIN, 3, -2), F.col("ref"), F.col("query")
    pairs = _short_pairs(spark, sf_dir).withColumn("a", al.align(r, q, w, -3, -1, "global")).withColumn("score", al.score(r, q, w, -3, -1, "global"))
    pairs = pairs.withColumn("scored_path", al.path_score(r, q, F.col("a"), w, -3, -1, "global")["score"])
    return pairs.select("p_partkey", "score", "scored_path", F.col("a.score").alias("aligned"), F.col("a.ref_end").alias("ref_end"), F.col("a.query_end").alias("query_end"))


@query("select p_partkey, abs(length(a) - length(b)) > floor(length(b) * 0.5) as apart, case when abs(length(a) - length(b)) > floor(length(b) * 0.5) then null when levenshtein(a, b) <= floor(length(b) * 0.5) then true end as known from (select p_partkey, " + f"{_A} as a, {_B} as b from part) where a <> '' and b <> ''")
def pre_filter_never_rejects(spark, sf_dir):
    """Pairs within the edits pass; where they are not the filter may say either, so only passes are compared."""
    f = al.pre_filter(F.col("ref"), F.col("query"), 0.5)
    near = F.levenshtein(F.col("ref"), F.col("query")) <= F.floor(F.length("query") * 0.5)
    out = _short_pairs(spark, sf_dir).withColumn("f", f)
    return out.select("p_partkey", F.col("f").isNull().alias("apart"), F.when(F.col("f").isNotNull() & near, F.col("f")).alias("known"))


@query(
    f"select l_orderkey, l_linenumber, case when l_partkey > 0 then cast(l_partkey as varchar) || 'S' else '' end || cast(q as varchar) || 'M2D' || cast(l_linenumber as varchar) || 'I3M4N1=' || '7S' as inverted, '1=4N3M' || cast(l_linenumber as varchar) || 'D2I' || cast(q as varchar) || 'M' || cast(l_linenumber as varchar) || 'S' as turned, 7 as turned_start, "
    "md5(repeat('A', q) || '--' || repeat('A', l_linenumber + 8)) as ref_row, md5(repeat('C', q + 2) || repeat('-', l_linenumber) || 'CCCNNNNC') as query_row, "
    "cast(l_linenumber as varchar) || 'S' || cast(q as varchar) || 'X2I' || cast(l_linenumber as varchar) || 'D3X4N1=' as verbose, "
    "cast(l_linenumber as varchar) || 'S' || cast(q as varchar) || 'M' || '6S' as sliced, l_linenumber as sliced_start, l_linenumber + q as sliced_end "
    f"from ({_LINES})"
)
def alignment_algebra(spark, sf_dir):
    """Alignments of a known path, inverted, turned, written out, compared letter by letter and cut to a range."""
    rows = _sam(spark, sf_dir).withColumn("ops", cg.ciglets(F.col("cigar")))
    rows = rows.withColumn("q", cg.query_len(F.col("ops"), True)).withColumn("r", cg.ref_len(F.col("ops"), True)).drop("ops")
    a = F.struct(F.lit("Some").alias("status"), F.lit(1).cast("bigint").alias("score"), F.col("pos").alias("ref_start"), (F.col("pos") + F.col("r")).alias("ref_end"), F.lit(0).cast("bigint").alias("query_start"), F.col("q").alias("query_end"), F.col("cigar").alias("cigar"), (F.col("pos") + F.col("r") + 7).alias("ref_len"), F.col("q").alias("query_len"))
    rows = rows.withColumn("a", a)
    # sequences whose aligned letters differ
    at0 = F.struct(F.col("a.status").alias("status"), F.col("a.score").alias("score"), F.lit(0).cast("bigint").alias("ref_start"), F.col("r").alias("ref_end"), F.lit(0).cast("bigint").alias("query_start"), F.col("q").alias("query_end"), F.col("cigar").alias("cigar"), F.col("r").alias("ref_len"), F.col("q").alias("query_len"))
    ref, qry = F.repeat(F.lit("A"), F.col("r").cast("int")), F.repeat(F.lit("C"), F.col("q").cast("int"))
    number = F.regexp_extract("cigar", "^([0-9]+)S", 1).cast("int")
    m = F.regexp_extract("cigar", "S([0-9]+)M", 1)
    pair = cg.aligned_pair(ref, qry, F.col("cigar"), F.lit(0))
    out = rows.select("qname", number.alias("l_linenumber"), m.alias("m"), "a", at0.alias("b"), ref.alias("ref"), qry.alias("qry"), pair.alias("pair"))
    verbose = al.verbose_matching(F.col("ref"), F.col("qry"), F.col("b"))
    low = out.withColumn("v", verbose).withColumn("cut", F.col("m").cast("bigint"))
    cut = low.withColumn("s", al.slice_to_ref_range(F.col("b"), 0, F.col("cut")))
    inv, rev = al.invert(F.col("a")), al.to_reverse(F.col("a"))
    return cut.select(F.col("qname").cast("bigint").alias("l_orderkey"), "l_linenumber", inv["cigar"].alias("inverted"), rev["cigar"].alias("turned"), rev["ref_start"].alias("turned_start"), F.md5("pair.ref").alias("ref_row"), F.md5("pair.query").alias("query_row"), F.regexp_replace("v", "1X$", "1=").alias("verbose"), F.col("s.cigar").alias("sliced"), F.col("s.query_start").alias("sliced_start"), F.col("s.query_end").alias("sliced_end"))


# CIGAR ------------------------------------------------------------------------------------------------------------------------------

_KINDS = ("10M5I20D", "M10D", "10M5I0D", "10MM5I", "", "*", "12M3X4=", "3M2D1M", "0M", "10M5I20", "5Q", "18446744073709551616M", "4S10M2I2D3M4H4P", "2H3S4M")
_VALID = (True, False, False, False, True, True, True, True, False, False, False, False, True, True)
_INDELS = (True, False, True, False, False, False, False, True, False, True, False, False, True, False)
_ERRORS = (None, "MissingInc", "IncZero", "MissingInc", None, None, None, None, "IncZero", "MissingOp", "InvalidOperation", "IncOverflow", None, None)
_sql = lambda values: "[" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in values) + "]"


@query(f"select p_partkey, ({_sql(_KINDS)})[p_partkey % 14 + 1] as cigar, ({_sql(_VALID)})[p_partkey % 14 + 1] as valid, ({_sql(_INDELS)})[p_partkey % 14 + 1] as indels, ({_sql(_ERRORS)})[p_partkey % 14 + 1] as error from part")
def cigar_checks(spark, sf_dir):
    """Valid and malformed strings, with and without insertions and deletions."""
    c = F.col("cigar")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 14 + 1).cast("int")).alias("cigar"))
    return rows.select("p_partkey", "cigar", cg.is_valid(c).alias("valid"), cg.has_indels(c).alias("indels"), cg.error(c).alias("error"))


@query(f"select l_orderkey, l_linenumber, case when l_linenumber > 1 then cast(q + l_linenumber as varchar) || 'M' || cast(l_linenumber - 1 as varchar) || 'I2M' else cast(q + 3 as varchar) || 'M' end as merged, cast(q as varchar) || 'M2I3M' as bare, l_linenumber as clipped_start, l_linenumber + 1 as clipped_end from ({_LINES})")
def cigar_states(spark, sf_dir):
    """Run-length encoding that merges equal neighbours and skips empty ones; clips taken off and counted."""
    n, k = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    state = lambda inc, op: F.struct(inc.alias("inc"), F.lit(op).alias("op"))
    states = F.array(state(n, "M"), state(k, "M"), state(k - 1, "I"), state(F.lit(2).cast("bigint"), "M"))
    text = F.concat(F.lit("2H"), k.cast("string"), F.lit("S"), n.cast("string"), F.lit("M2I3M"), (k + 1).cast("string"), F.lit("S1H"))
    clip = cg.clipped(F.col("c"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", states.alias("s"), text.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", cg.of_ciglets(cg.merged(F.col("s"))).alias("merged"), cg.without_clipping(F.col("c")).alias("bare"), clip["start"].alias("clipped_start"), clip["end"].alias("clipped_end"))


# Samplers, generators and profile HMMs ----------------------------------------------------------------------------------------------

_DRAW = "cast('0x' || substring(md5('42:' || cast(event_id as varchar)), 1, 13) as bigint)"


@query(f"select event_id, event_type from events where {_DRAW} / 4503599627370496.0 < 0.1")
def sample_bernoulli(spark, sf_dir):
    return sp.bernoulli(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 0.1)


@query(f"select event_id, event_type from events order by {_DRAW}, event_id limit 500")
def sample_reservoir(spark, sf_dir):
    return sp.reservoir(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 500)


@query(f"select event_id, row_number() over (order by event_id) as place from (select event_id from events order by {_DRAW}, event_id limit 300)")
def sample_known_size(spark, sf_dir):
    from pyspark.sql import Window

    rows = sp.known_size(table(spark, sf_dir, "events").select("event_id"), "event_id", 300)
    return rows.select("event_id", F.row_number().over(Window.orderBy("event_id")).cast("bigint").alias("place"))


@query()
def random_sequences(spark, sf_dir):
    """A seeded sequence for each part; tested against the published generator's numbers."""
    return table(spark, sf_dir, "part").select("p_partkey", ge.random_sequence(F.col("p_partkey"), F.col("p_size"), "ACGT").alias("sequence"))


_P = {"mm": 0.7, "md": 0.1, "mi": 0.2, "dm": 0.6, "dd": 0.4, "im": 0.5, "ii": 0.5}
_EMIT, _OTHER = 0.7, 0.1


def _two_states() -> phmm.Model:
    """Two match states that prefer A and G; inserts are uniform."""
    import numpy as np

    t = np.full((3, 3, 3), np.inf)
    cost = {k: -np.log(v) for k, v in _P.items()}
    for j in range(3):
        t[j] = [[cost["mm"], cost["dm"], cost["im"]], [cost["md"], cost["dd"], np.inf], [cost["mi"], np.inf, cost["ii"]]]
    t[0, :, 1] = np.inf
    t[2, 1, :] = np.inf
    emit = lambda c: [-np.log(_EMIT if x == c else _OTHER) for x in "ACGT"]
    match = np.array([emit("A"), emit("G"), [np.inf] * 4])
    return phmm.Model("ACGT", "A", t, match, np.full((3, 4), -np.log(0.25)))


def _viterbi_sql() -> str:
    """The best global path's score over the letters of part names, by the three nodes' states after each letter."""
    c = {k: f"(-ln({v}))" for k, v in _P.items()}
    far, e = "1e9", lambda base: f"(case when x = '{base}' then -ln({_EMIT}) else -ln({_OTHER}) end)"
    # m0 (BEGIN), i0, m1, i1, d1, m2, i2, d2 after i letters
    m1 = f"least(m0 + {c['mm']}, i0 + {c['im']}) + {e('A')}"
    m2 = f"least(m1 + {c['mm']}, i1 + {c['im']}, d1 + {c['dm']}) + {e('G')}"
    step = {"m0": far, "i0": f"least(m0 + {c['mi']}, i0 + {c['ii']}) + ln(4)", "m1": m1, "i1": f"least(m1 + {c['mi']}, i1 + {c['ii']}) + ln(4)", "m2": m2, "i2": f"least(m2 + {c['mi']}, i2 + {c['ii']}) + ln(4)"}
    new = ", ".join(f"{v} as {k}" for k, v in step.items())
    deletes = f"least(m0 + {c['md']}, {far}) as d1, least(m1 + {c['md']}, least(m0 + {c['md']}, {far}) + {c['dd']}) as d2"
    s = "regexp_replace(upper(p_name), '[^ACGT]+', '', 'g')"
    return (
        f"with recursive p as (select p_partkey, {s} as s from part where {s} <> ''), "
        f"t as (select p_partkey, s, 0 as i, *, {deletes} from (select p_partkey, s, 0.0::double as m0, {far}::double as i0, {far}::double as m1, {far}::double as i1, {far}::double as m2, {far}::double as i2 from p) u(p_partkey, s, m0, i0, m1, i1, m2, i2)"
    ).replace("select p_partkey, s, 0 as i, *, ", "select p_partkey, s, 0 as i, m0, i0, m1, i1, m2, i2, ") + (
        f" union all select p_partkey, s, i + 1, m0, i0, m1, i1, m2, i2, {deletes} from (select p_partkey, s, i, {new} from (select *, substring(s, i + 1, 1) as x from t where i < length(s)))) "
        f"select p_partkey, s as sequence, round(least(m2 + {c['mm']}, i2 + {c['im']}, d2 + {c['dm']}), 6) as score from t where i = length(s)"
    )


@query(_viterbi_sql())
def phmm_scores(spark, sf_dir):
    """The best global path of each part's name through a model of two match states, read from its text."""
    model = phmm.parse(phmm.to_text(_two_states()))
    s = F.regexp_replace(F.upper("p_name"), "[^ACGT]+", "")
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("sequence")).where("sequence <> ''")
    return dealt(rows, "p_partkey").select("p_partkey", "sequence", phmm.align(F.col("sequence"), model, "global").alias("a")).select("p_partkey", "sequence", F.round("a.score", 6).alias("score"))
