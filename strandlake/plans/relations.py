"""Queries of malformed files and of tables aligned with tables. Their SQL states letters, orders and scores as literals of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.functions import tables
from strandlake.functions.alphabets import ByteMap
from strandlake.operators import kmers as km
from strandlake.operators import mismatches as mm
from strandlake.operators import seeding as sd
from strandlake.operators import sites as si
from strandlake.operators import superkmers as sk
from strandlake.operators import tags as tg
from strandlake.plans.queries import _AA, _OVER, DNA, ORACLE_SQL, QUAL, SEQ, T, dna, iupac, quality, query, table
from strandlake.sources import fasta, fastq, formats, sam
from strandlake.sources.modes import separated
from strandlake.sources.scratch import scratch

# Malformed records -----------------------------------------------------------------------------------------------------------


def _kinds(fault, kinds: dict[str, str]):
    out = F.lit(None).cast("string")
    for text, kind in kinds.items():
        out = F.when(F.contains(fault, F.lit(text)), kind).otherwise(out)
    return out


@query(
    "select case when doc_id % 5 = 2 then '' else 'doc' || cast(doc_id as varchar) end as header, md5(repeat('ACGTN', (length(q) + 4) // 5)[1 : length(q)]) as sequence, case doc_id % 5 when 1 then 'length' when 2 then 'header' when 3 then 'graphic' end as fault "
    f"from (select doc_id, {QUAL} as q from documents) where length(q) > 1"
)
def fastq_faults(spark, sf_dir):
    """Documents as FASTQ records, three fifths of them malformed, read in many splits with their faults."""
    kind, q = F.col("doc_id") % 5, F.col("q")
    rows = table(spark, sf_dir, "documents").select("doc_id", quality(T).alias("q")).where(F.length("q") > 1)
    sequence = F.substring(F.repeat(F.lit("ACGTN"), F.ceil(F.length(q) / 5).cast("int")), F.lit(1), F.length(q))
    scores = F.when(kind == 1, F.substr(q, F.lit(2), F.length(q))).when(kind == 3, F.concat(F.lit(" "), F.substr(q, F.lit(2), F.length(q)))).otherwise(q)
    lines = F.concat_ws("\n", F.when(kind == 2, "@").otherwise(F.concat(F.lit("@doc"), F.col("doc_id").cast("string"))), sequence, F.lit("+"), scores)
    path = scratch(spark)
    rows.select(lines.alias("value")).write.text(path)
    read = fastq.read_fastq(spark, path, "PERMISSIVE", split_bytes=1 << 18)
    return read.select("header", F.md5("sequence").alias("sequence"), _kinds(F.col("_corrupt_record"), {"length mismatch": "length", "missing FASTQ header": "header", "graphic": "graphic"}).alias("fault"))


@query(
    "select fault, count(*) as records, sum(bases) as bases from (select case when doc_id % 7 = 0 then 'header' when doc_id % 7 = 1 then 'stray' when s = '' then 'empty' end as fault, length(s) + case when doc_id % 7 = 1 then 2 else 0 end as bases "
    f"from (select doc_id, {DNA} as s from documents)) group by fault"
)
def fasta_faults(spark, sf_dir):
    """Documents as FASTA records, some without a name, with a stray mark or without bases: the faults and bases of both sides of one pass."""
    kind = F.col("doc_id") % 7
    rows = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    name = F.when(kind == 0, "").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    body = F.when(kind == 1, F.concat(F.lit("A>"), F.col("s"))).otherwise(F.col("s"))
    path = scratch(spark)
    rows.select(F.concat(F.lit(">"), name, F.lit("\n"), body).alias("value")).write.text(path)
    good, bad, _ = separated(fasta.read_fasta(spark, path, "PERMISSIVE"))
    fault = _kinds(F.col("_corrupt_record"), {"header is empty": "header", "inside a line": "stray", "sequence is empty": "empty"})
    both = good.select(F.lit(None).cast("string").alias("fault"), "sequence").unionByName(bad.select(fault.alias("fault"), "sequence"))
    return both.groupBy("fault").agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("bases"))


@query(
    "select fault, count(*) as records, sum(pos) as pos from (select case l_linenumber when 3 then 'flag' when 5 then 'position' when 6 then 'fields' end as fault, case when l_linenumber = 5 then null else l_partkey end as pos from lineitem) group by fault"
)
def sam_faults(spark, sf_dir):
    """Line items as SAM rows, some with a bad flag, a negative position or a field too few: the faults of all."""
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    fields = [F.col("l_orderkey").cast("string"), F.when(n == 3, "x").otherwise("0"), F.col("l_returnflag"), F.when(n == 5, F.concat(F.lit("z"), part)).otherwise(part), F.lit("60"), F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT")]
    line = F.concat_ws("\t", *fields)
    path = scratch(spark)
    table(spark, sf_dir, "lineitem").select(F.when(n == 6, line).otherwise(F.concat(line, F.lit("\tIIII"))).alias("value")).write.text(path)
    read = sam.read_sam(spark, path, "PERMISSIVE")
    fault = _kinds(F.col("_corrupt_record"), {"flag": "flag", "position": "position", "fields": "fields"})
    return read.groupBy(fault.alias("fault")).agg(F.count("*").alias("records"), F.sum("pos").alias("pos"))


# Tables aligned with tables ---------------------------------------------------------------------------------------------------


def _seeds(spark, sf_dir, k, w):
    items = table(spark, sf_dir, "benchmark").select("item_id", dna(T).alias("s"))
    docs = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    return items, docs, sd.minimizers(items, "item_id", "s", k, w, F.md5), sd.minimizers(docs, "doc_id", "s", k, w, F.md5)


@query(
    f"with s as (select 'q' as side, item_id as id, {DNA} as s from benchmark union all select 'r', doc_id, {DNA} from documents), "
    "k as (select side, id, length(s) - 11 as n, unnest(range(0, length(s) - 11)) as i, unnest([substring(s, i, 12) for i in range(1, length(s) - 10)]) as seed from s where length(s) >= 12), "
    "t as (select side, id, n, i, min(md5(seed) || lpad(cast(i as varchar), 12, '0') || seed) over (partition by side, id order by i rows between current row and 5 following) as least from k), "
    "p as (select distinct side, id, cast(least[33:44] as bigint) as p, least[45:] as seed from t where i <= greatest(n - 6, 0)), "
    "n as (select a.id as q, b.id as r, b.p - a.p as diag, count(*) as n from p a join p b on a.seed = b.seed where a.side = 'q' and b.side = 'r' group by a.id, b.id, b.p - a.p), "
    "o as (select *, row_number() over (partition by q, r order by n desc, diag) as place from n), "
    "u as (select q, r, diag, n, substring(a.s, greatest(1 - diag, 1)) as a, substring(b.s, greatest(diag + 1, 1)) as b from o join s a on a.id = o.q and a.side = 'q' join s b on b.id = o.r and b.side = 'r' where place = 1) "
    "select q as item_id, r as doc_id, cast(diag as bigint) as diag, n as n_seeds, least(length(a), length(b)) as overlap, len([i for i in range(1, least(length(a), length(b)) + 1) if a[i] = b[i]]) as matches from u"
)
def seeded_diagonals(spark, sf_dir):
    """Every benchmark item against all documents: the diagonal of most seeds of each pair that a seed proposes, and its equal bases."""
    items, docs, q, r = _seeds(spark, sf_dir, 12, 6)
    best = sd.diagonals(sd.hits(q, r)).withColumnsRenamed({"query": "item_id", "ref": "doc_id"})
    both = best.join(docs.withColumnRenamed("s", "b"), "doc_id").join(items.withColumnRenamed("s", "a"), "item_id")
    along = sd.ungapped(F.col("a"), F.col("b"), F.col("diag"))
    return both.select("item_id", "doc_id", F.col("diag").cast("bigint").alias("diag"), "n_seeds", along["length"].alias("overlap"), along["matches"].alias("matches"))


@query()
def seeded_chains(spark, sf_dir):
    """The document of the best collinear chain of seeds for each benchmark item."""
    _, _, q, r = _seeds(spark, sf_dir, 10, 5)
    return sd.best_references(sd.chains(sd.hits(q, r), 10)).withColumnsRenamed({"query": "item_id", "ref": "doc_id"})


# Formats ------------------------------------------------------------------------------------------------------------------------


@query(f"select 'doc' || cast(doc_id as varchar) as header, md5(repeat('ACGTN', (length(q) + 4) // 5)[1 : length(q)]) as sequence, md5(q) as quality from (select doc_id, {QUAL} as q from documents) where length(q) > 0 and doc_id % 2 = 0")
def fastq_format(spark, sf_dir):
    """Documents as FASTQ records, written through the format and read back in splits, where headers are tested as they are parsed."""
    formats.register(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", quality(T).alias("quality")).where("quality <> ''")
    n = F.length("quality")
    rows = rows.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "doc").otherwise("odd"), F.col("doc_id").cast("string")).alias("header"), F.substring(F.repeat(F.lit("ACGTN"), F.ceil(n / 5).cast("int")), F.lit(1), n).alias("sequence"), "quality")
    path = scratch(spark)
    rows.write.format("fastq").mode("append").save(path)
    read = spark.read.format("fastq").option("splitBytes", 1 << 20).load(path)
    return read.where(F.startswith("header", F.lit("doc"))).select("header", F.md5("sequence").alias("sequence"), F.md5("quality").alias("quality"))


# Packed k-mers, searches with mismatches, sites by key ------------------------------------------------------------------------------


@query(f"select kmer, count(*) as count from (select unnest([replace(substring(s, i, 31), 'N', 'A') for i in range(1, length(s) - 29)]) as kmer from (select {DNA} as s from documents) where length(s) >= 31) group by kmer")
def kmer_counts_packed(spark, sf_dir):
    """All 31-mers of documents with their counts, from super-k-mers."""
    return sk.kmer_counts(table(spark, sf_dir, "documents").select(dna(T).alias("s")), "s", 31)


@query(
    f"with q as (select distinct unnest([substring(s, i, 18) for i in range(1, length(s) - 16)]) as a from (select {DNA} as s from benchmark) where length(s) >= 18), "
    "r as (select distinct substring(a, 1, 5) || case when a[6] = 'A' then 'C' else 'A' end || substring(a, 7, 6) || case when a[13] = 'T' then 'G' else 'T' end || substring(a, 14) as b from q) "
    "select a, b, cast(hamming(a, b) as integer) as mismatches from q, r where hamming(a, b) <= 3"
)
def kmer_near_matches(spark, sf_dir):
    """The 18-mers of benchmark items against themselves with two letters changed: all pairs within three mismatches."""
    q = km.kmers(table(spark, sf_dir, "benchmark").select(dna(T).alias("s")), "s", 18).select("kmer").distinct()
    part = lambda a, n=18: F.substring("kmer", a, n)
    changed = F.concat(part(1, 5), F.when(part(6, 1) == "A", "C").otherwise("A"), part(7, 6), F.when(part(13, 1) == "T", "G").otherwise("T"), part(14))
    return mm.near(q, q.select(changed.alias("kmer")), 18, 3)


@query(
    "select lang, pos, " + ", ".join(f"count(*) filter (where c in ({', '.join(repr(x) for x in letters)})) as \"{name}\"" for name, letters in {"a": "Aa", "c": "Cc", "g": "Gg", "t": "TtUu", "n": "Nn", "gap": "-", "other": "RYSWKMBDHVryswkmbdhv."}.items())
    + f", count(*) filter (where c in (':', '~')) as invalid from (select lang, unnest(range(0, length(s))) as pos, unnest(string_split(s, '')) as c from (select lang, {SEQ} as s from documents) where s <> '') group by lang, pos"
)
def site_counts_by_key(spark, sf_dir):
    """The eight counts of each site of the documents of each language, merged in blocks."""
    return si.site_counts(table(spark, sf_dir, "documents").select("lang", iupac(T).alias("s")), "s", "lang")


# Optional SAM fields --------------------------------------------------------------------------------------------------------------

_ITEM = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) as q, l_returnflag from lineitem"


def _tagged(spark, sf_dir):
    """Line items with optional fields of every type; by line number some have a malformed field, before or after the others."""
    line = F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), "l_returnflag")
    fields = F.when(line == 2, F.array(F.lit("bad"))).when(line == 3, F.array(F.lit("XQ:f:1.5d"))).when(line == 4, F.array(F.concat(F.lit("AS:i:"), F.col("l_partkey").cast("string"), F.lit(".0"))))
    fields = F.coalesce(fields, F.array().cast("array<string>"))
    shown = [("AS", tg.show_integer(-F.col("l_partkey"))), ("XA", tg.show_char(F.col("l_returnflag"))), ("XF", tg.show_real(F.col("q") / 4)), ("XZ", tg.show_string(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")))), ("XH", tg.show_hexadecimal(F.lower(F.hex(F.encode("l_returnflag", "utf-8"))))), ("XB", tg.show_items(F.array(F.col("q"), F.col("l_linenumber")), "c")), ("XI", tg.show_items(F.array(F.col("l_partkey").cast("bigint") + 4000000000), "I"))]
    for tag, text in shown:
        fields = tg.push(fields, tag, text)
    fields = F.when(line == 5, F.array_append(fields, F.lit("bad"))).when(line == 6, F.array_append(fields, F.lit("AS:i:1"))).otherwise(fields)
    return rows.select("l_orderkey", "l_linenumber", fields.alias("opt_fields"))


@query(
    "select l_orderkey, l_linenumber, case l_linenumber when 2 then 'no colon' when 4 then 'malformed' end as fault, case when l_linenumber not in (2, 4) then -l_partkey end as score, "
    + ", ".join(f"case when l_linenumber <> 2 then {e} end as {n}" for n, e in {"one": "l_returnflag", "f": "q / 4.0::double", "text": "'s:' || cast(l_suppkey as varchar)", "hex": "case l_returnflag when 'A' then '41' when 'N' then '4E' when 'R' then '52' end", "items": "cast(q as varchar) || ';' || cast(l_linenumber as varchar)", "big": "l_partkey + 4000000000"}.items())
    + f", case when l_linenumber in (2, 5) then true else false end as missing_raises from ({_ITEM})"
)
def sam_typed_fields(spark, sf_dir):
    """Optional fields of every type pushed, parsed once and looked up, with what a lookup of two tags would raise."""
    v = F.col("v")
    rows = _tagged(spark, sf_dir).select("l_orderkey", "l_linenumber", tg.parsed(F.col("opt_fields")).alias("v"))
    numbers = F.array_join(F.transform(tg.items(v, "XB", strict=False), lambda x: x.cast("string")), ";")
    return rows.select("l_orderkey", "l_linenumber", _kinds(tg.fault(v, "AS"), {"malformed": "malformed", "without a colon": "no colon"}).alias("fault"), tg.integer(v, "AS", False).alias("score"), tg.char(v, "XA", False).alias("one"), tg.real(v, "XF", False).cast("double").alias("f"), tg.string(v, "XZ", False).alias("text"), tg.hexadecimal(v, "XH", False).alias("hex"), numbers.alias("items"), F.get(tg.items(v, "XI", strict=False), F.lit(0)).alias("big"), tg.fault(v, "QQ").isNotNull().alias("missing_raises"))


@query(
    f"with r as ({_ITEM}), good as (select l_linenumber, t.tag, t.type, cast(null as varchar) as fault, t.place + case when l_linenumber in (2, 3, 4) then 1 else 0 end as place from r, (values (0, 'AS', 'i'), (1, 'XA', 'A'), (2, 'XF', 'f'), (3, 'XZ', 'Z'), (4, 'XH', 'H'), (5, 'XB', 'B'), (6, 'XI', 'B')) t(place, tag, type)), "
    "other as (select l_linenumber, t.tag, t.type, t.fault, t.place from r join (values (2, 0, 'bad', null, 'no colon'), (3, 0, 'XQ', 'f', 'malformed value of type f'), (4, 0, 'AS', 'i', 'malformed value of type i'), (5, 7, 'bad', null, 'no colon'), (6, 7, 'AS', 'i', null)) t(line, place, tag, type, fault) on l_linenumber = t.line) "
    "select tag, type, fault, count(*) as fields, cast(sum(place) as bigint) as places from (from good union all by name from other) group by tag, type, fault"
)
def sam_field_rows(spark, sf_dir):
    """All optional fields as rows, malformed ones with their fault, counted."""
    rows = tg.rows(_tagged(spark, sf_dir), "opt_fields", mode="PERMISSIVE")
    return rows.groupBy("tag", "type", F.col("_corrupt_record").alias("fault")).agg(F.count("*").alias("fields"), F.sum("at").alias("places"))


# Table functions in SQL text ------------------------------------------------------------------------------------------------------


def _in_sql(spark, text: str, **frames):
    """The rows of SQL text over frames, which it names."""
    tables.register(spark)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text)


@query(f"select kmer, count(*) as count, cast(sum(pos) as bigint) as places from (select s[i + 1 : i + 21] as kmer, i as pos from (select s, unnest(range(0, length(s) - 20)) as i from (select {DNA} as s from documents) where length(s) >= 21)) group by kmer")
def sql_kmers(spark, sf_dir):
    """All 21-mers of documents by table functions: sequences cut to pieces, pieces to k-mers."""
    text = "select kmer, count(*) as count, sum(p.start + k.pos) as places from dna_of_documents d, lateral sequence_pieces(d.s, 21) p, lateral kmers(p.piece, 21, 'N') k group by kmer"
    return _in_sql(spark, text, dna_of_documents=table(spark, sf_dir, "documents").select(dna(T).alias("s")))


@query(f"select doc_id, i as pos, s[i + 1 : i + 50] as part from (select doc_id, s, unnest(range(0, length(s) - 49, 35)) as i from (select doc_id, {DNA} as s from documents) where length(s) >= 50)")
def sql_windows(spark, sf_dir):
    """Full windows of 50 bases at every 35th base of documents."""
    return _in_sql(spark, "select doc_id, w.pos, w.part from dna_of_documents d, lateral stepped_windows(d.s, 50, 35) w", dna_of_documents=table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s")))


@query("select op, count(*) as ciglets, cast(sum(inc) as bigint) as total, cast(sum(place) as bigint) as places from (select unnest([{'place': 0, 'inc': l_linenumber, 'op': 'S'}, {'place': 1, 'inc': cast(l_quantity as int), 'op': 'M'}, {'place': 2, 'inc': l_suppkey, 'op': 'D'}], recursive := true) from lineitem) group by op")
def sql_ciglets(spark, sf_dir):
    """The operations of line items' CIGAR strings up to a malformed place, tallied."""
    cigar = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_suppkey").cast("string"), F.lit("D?5M"))
    return _in_sql(spark, "select op, count(*) as ciglets, sum(inc) as total, sum(c.place) as places from cigars, lateral ciglets(cigar) c group by op", cigars=table(spark, sf_dir, "lineitem").select(cigar.alias("cigar")))


@query(ORACLE_SQL["site_counts_by_key"])
def sql_site_counts(spark, sf_dir):
    """The counts of each site of the documents of each language by a table function that deals a language to several tasks."""
    sums = ", ".join(f"cast(sum({x}) as bigint) as {x}" for x in si.SLOTS)
    text = f"select lang, pos, {sums} from site_counts(table(letters_of_documents), 'lang', 's', spread => 'doc_id') group by lang, pos"
    return _in_sql(spark, text, letters_of_documents=table(spark, sf_dir, "documents").select("doc_id", "lang", iupac(T).alias("s")))


@query(
    "with s as (select distinct l_suppkey, l_partkey from lineitem), g as (select *, l_partkey - row_number() over (partition by l_suppkey order by l_partkey) as island from s) "
    "select l_suppkey, min(l_partkey) as start, string_agg(substring('ACGTN', l_partkey % 5 + 1, 1), '' order by l_partkey) as text from g group by l_suppkey, island"
)
def sql_runs(spark, sf_dir):
    """A letter for each part that a supplier ships, at the part's number; letters of neighbouring numbers joined."""
    letters = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.substring(F.lit("ACGTN"), F.col("l_partkey") % 5 + 1, F.lit(1)).alias("letter"))
    return _in_sql(spark, "select l_suppkey, start, text from joined", joined=tables.joined_runs(letters, "l_partkey", "letter", "l_suppkey"))


# Translation forms, ranges of maps, and the header of a sorted file ---------------------------------------------------------------

_FRAMES = f"select doc_id, s, {_AA} as t, {_OVER} as o from (select doc_id, {DNA} as s from documents)"


@query(
    "select doc_id, md5(t) as exact, md5(t || case when length(s) % 3 > 0 then '?' else '' end) as own_sign, md5(regexp_extract(t || case when length(s) % 3 > 0 then '~' else '' end, '^[^*]*\\*?', 0)) as to_stop, "
    "nullif(position('M' in substring(o, 8)), 0) + 6 as next_m_from_7, (nullif(position('M' in substring(t, 4)), 0) + 2) * 3 as next_m_in_frame_from_7 "
    f"from ({_FRAMES})"
)
def translation_forms(spark, sf_dir):
    """Translations without a partial codon, with a sign of one's own for it and up to the first stop; residues found from a place on."""
    s = F.col("s")
    base = table(spark, sf_dir, "documents").select("doc_id", dna(T).alias("s"))
    own = sq.translate(s, partial="?")
    return base.select("doc_id", F.md5(sq.translate(s, exact=True)).alias("exact"), F.md5(own).alias("own_sign"), F.md5(sq.translate_to_stop(s)).alias("to_stop"), sq.find_next_aa(s, "M", 7).cast("bigint").alias("next_m_from_7"), sq.find_next_aa_in_frame(s, "M", 7).cast("bigint").alias("next_m_in_frame_from_7"))


@query("select doc_id, md5(regexp_replace(translate(text, 'abcdefgh', '--------'), '[^0-9\\-A-F]', '_', 'g')) as mapped, length(regexp_replace(text, '[a-hk-m]', '', 'g')) as left_over from documents where text is not null")
def mapped_ranges(spark, sf_dir):
    """Maps of ranges: some to one letter, some kept, the rest to a default; and ranges left out."""
    one = ByteMap("_").preserve_range("0", "9").preserve_range("A", "F").preserve("-").map_range_to_one("a", "h", "-").map_range_to_one("z", "y", "!")
    gone = ByteMap().map_range_to_one("a", "h", "").map_range_to_one("k", "m", "")
    return table(spark, sf_dir, "documents").where(F.col(T).isNotNull()).select("doc_id", F.md5(one.apply(F.col(T))).alias("mapped"), F.length(gone.apply(F.col(T))).alias("left_over"))


@query("select idx, line from (select -1 as idx, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:coordinate' as line union all select nationkey, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || cast(nationkey + 1 as varchar) from (select n_nationkey as nationkey, n_name as name from nation))")
def sam_sorted_header(spark, sf_dir):
    """A header with a sequence for each nation, its first line put in place of the one for coordinate order."""
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), (F.col("n_nationkey") + 1).cast("string")).alias("line"), F.col("n_nationkey").cast("int").alias("idx"))
    old = lines.where("idx = 0").select(F.lit("@HD\tVN:1.5\tSO:unsorted").alias("line"), F.lit(-1).alias("idx"))
    return sam.sorted_header(lines.unionByName(old)).select("idx", "line")
