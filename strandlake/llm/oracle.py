"""DuckDB SQL of the queries that SQL can express, over the same tables.

Tokenizers, classifiers and the HTML parser have none; the tests compare these with brute-force versions.
"""

from __future__ import annotations

import re

from strandlake.llm import quality_rules, secrets_scan, url_filter

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    return f"""
with d as (select doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '{_ALNUM}') as w from benchmark where item_id is not null),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') as g from (select item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as g from (select doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) as i from d, lengths)),
hits as (select doc_id, i, dw.n as n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as listed from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered c on c.doc_id = d.doc_id left join items t on t.doc_id = d.doc_id"""


def _op2() -> str:
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) as i from d)),
firsts as (select g, min(doc_id) as doc from windows group by g),
places as (select g, doc, min(i) as first_at from windows join firsts using (g) where doc_id = doc group by g, doc),
again as (select doc_id, i from windows join places using (g) where doc_id > doc or i > first_at),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from again)),
words as (select doc_id, p, w[p + 1] as x from (select doc_id, w, unnest(range(0, len(w))) as p from d)),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) as t, count(*) as n from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id)
select d.doc_id, len(d.w) as n_words, len(d.w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""


def _op5() -> str:
    parts = []
    for rank, rule in enumerate(secrets_scan.RULES):
        pattern = rule.pattern
        if pattern.startswith("(?i)"):  # only ASCII letters have two cases
            head, tail = pattern[4:].split(")", 1)
            pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + tail
        p = pattern.replace("'", "''")
        size = f"regexp_extract_all(t, '{p}', {rule.group})" if rule.group else "m"
        parts.append(
            f"select doc_id, {rank} as rank, '{rule.kind}' as kind, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) as s, list_sum([length(x) for x in gaps[1:i]]) + list_sum([length(x) for x in m[1:i]]) as e, length(sizes[i]) as n, {rule.at_least} as least from "
            f"(select doc_id, m, gaps, {size} as sizes, unnest(range(1, len(m) + 1)) as i from (select doc_id, t, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as gaps from d where regexp_matches(t, '{p}')))"
        )
    n = len(secrets_scan.BASE_RULES)
    text = "kind || ':' || cast(cast(s as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets_scan.BASE_RULES)
    sums = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets_scan.BASE_RULES)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
spans as (select * from ({" union all ".join(parts)}) where n >= least),
found as (select doc_id, {sums}, string_agg({text}, ',' order by s, rank, e) filter (where rank < {n}) as base, string_agg({text}, ',' order by s, rank, e) as every from spans group by doc_id)
select d.doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans from d left join found on found.doc_id = d.doc_id"""


def _op7() -> str:
    return f"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '{_WORD}') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) as g from (select doc_id, w, unnest(range(0, case when len(w) = 0 then 0 else greatest(len(w) - 4, 1) end)) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d join least on least.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""


def _op8() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in rules) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules) + " end"
    wide = "regexp_matches(name, '(^|\\.)(" + "|".join(url_filter.SECOND_LEVEL) + ")\\.[a-z]{2}$')"
    part = lambda k: f"array_to_string(string_split(name, '.')[greatest(len(string_split(name, '.')) - {k - 1}, 1):], '.')"
    rho = lambda src, mean: f"(select coalesce(case when w > 0 then 1 / least(greatest((s - v) / w, 0.001), 0.5) - 1 end, 1.0) from (select sum(n * pow(k / n - {mean}, 2)) as s, sum({mean} * (1 - {mean})) as v, sum((n - 1) * {mean} * (1 - {mean})) as w from {src} where n > 0))"
    # the share of a beta distribution up to one half, by the power series of the incomplete beta function
    below = "exp((a + b) * ln(0.5) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * list_sum([exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln(0.5)) for i in range(0, 3000)])"
    return f"""
with u as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substring(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
o as (select doc_id, count(*) as n, sum(case when bad then 1 else 0 end) as k from (select doc_id, quality = 0 or toxic = 1 as bad from labels) where bad is not null group by doc_id),
h0 as (select host, cast(coalesce(sum(n), 0) as double) as n, cast(coalesce(sum(k), 0) as double) as k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from p left join o on o.doc_id = p.page_id group by host),
h1 as (select host, n, k, case when regexp_matches(name, '^[0-9.]+$') or starts_with(name, '[') then name when {wide} then {part(3)} else {part(2)} end as domain, case when regexp_matches(name, '^[0-9.]+$') or starts_with(name, '[') then 'address' when {wide} then {part(2)} else {part(1)} end as suffix from h0),
t as (select (sum(k) + 0.5) / (sum(n) + 1) as m0 from h1),
s0 as (select suffix, sum(n) as n, sum(k) as k, max(m0) as above from h1, t group by suffix),
s1 as (select suffix, (k + r * above) / (n + r) as above from s0, (select {rho("s0", "above")} as r)),
d0 as (select domain, h1.suffix as suffix, sum(n) as n, sum(k) as k, max(above) as above from h1 join s1 on s1.suffix = h1.suffix group by domain, h1.suffix),
d1 as (select domain, suffix, (k + r * above) / (n + r) as above from d0, (select {rho("d0", "above")} as r)),
h2 as (select host, n, k, above from h1 join d1 on d1.domain = h1.domain and d1.suffix = h1.suffix),
h3 as (select host, k + r * above as a, n - k + r * (1 - above) as b from h2, (select {rho("h2", "above")} as r)),
h4 as (select host, {below} < 0.05 as bad from h3)
select page_id, p.host as host, path, {rule.replace("host", "p.host")} as rule, coalesce({verdict.replace("host", "p.host")}, case when bad then 'block' else 'allow' end) as verdict from p join h4 on h4.host = p.host"""


def _op4() -> str:
    words, n = quality_rules.COMMON_WORDS, len(quality_rules.COMMON_WORDS)
    line = r"[^\x20\x09-\x0D]"
    counts = ", ".join(f"len([x for x in w if x = '{x}'])" for x in words)
    listed = ", ".join(f"'{x}'" for x in words)
    dist = lambda p, q: f"sqrt(greatest(list_sum([(case when {p}[i] > 0 then {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) else 0 end + case when {q}[i] > 0 then {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) else 0 end) / 2 for i in range(1, len({p}) + 1)]), 0))"
    mean = lambda k, m: "[" + ", ".join(f"avg({k}[{i + 1}])" for i in range(m)) + "]"
    limit = lambda x: f"{x[0]} + {x[1]} / sqrt(greatest(n_words, 1))"
    long_ = f"word_chars >= {quality_rules.MIN_CHARS_JUDGED} and n_words >= {quality_rules.MIN_WORDS_JUDGED}"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 3], ' ')) as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) as i from d)),
r as (select doc_id, count(distinct p) as n from (select g.doc_id, unnest(range(i, i + 3)) as p from g join (select doc_id, g from g group by doc_id, g having count(*) > 1) t on t.doc_id = g.doc_id and t.g = g.g) group by doc_id),
l as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '{line}') group by doc_id),
c as (select d.doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) as chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_upper, length(regexp_replace(text, '[^\p{{Nd}}]+', '', 'g')) as n_digits, length(regexp_replace(text, '[^\p{{P}}]+|[#*%&]+', '', 'g')) as n_points, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, [x for x in w if x in ({listed})] as w from d left join r on r.doc_id = d.doc_id left join l on l.doc_id = d.doc_id),
h as (select *, [greatest(word_chars - n_upper - n_digits - n_points - n_symbols, 0), n_upper, n_digits, n_points, n_symbols, chars - word_chars] as hc, [n_words - len(w), {counts}] as hw from c),
q as (select *, [x / greatest(cast(list_sum(hc) as double), 1) for x in hc] as pc, [x / greatest(cast(list_sum(hw) as double), 1) for x in hw] as pw from h),
ref as (select lang, {mean("pc", 6)} as rc, {mean("pw", n + 1)} as rw from q where {long_} group by lang),
every as (select {mean("pc", 6)} as ac, {mean("pw", n + 1)} as aw from q where {long_}),
j as (select q.*, coalesce(rc, ac) as fc, coalesce(rw, aw) as fw, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words as base_failed from q left join ref on ref.lang = q.lang, every)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (word_chars >= {quality_rules.MIN_CHARS_JUDGED} and {dist("pc", "fc")} > {limit(quality_rules.CLASS_LIMIT)}) and not (n_words >= {quality_rules.MIN_WORDS_JUDGED} and {dist("pw", "fw")} > {limit(quality_rules.WORD_LIMIT)}) as kept from j"""


def _op12() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '{term}') as w from documents),
s as (select count(*) filter (where len(w) > 0) as docs, cast(sum(len(w)) as bigint) as terms from d),
i as (select item_id, t, count(*) as q from (select item_id, unnest(regexp_extract_all({_LOW}, '{term}')) as t from (select distinct item_id, text from benchmark where item_id is not null)) group by item_id, t),
f as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) where t in (select t from i) group by r, t),
g as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as weight from (select t, count(*) as df from f group by t), s),
m as (select r, doc_id, 100 - 75 + (75 * len(w) * docs) // terms as m from d, s where len(w) > 0),
p as (select item_id, r, cast(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from i join f using (t) join g using (t) join m using (r) group by item_id, r),
o as (select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank from p join m using (r) where score > 0)
select item_id, rank, doc_id, score from o where rank <= 10"""


def _op13() -> str:
    run = "[A-Za-z\u00C0-\u00FF]{6,}"
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    code = "list_transform(string_split({0}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)"
    return f"""
with recursive crc as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(256) r(i))),
o as (select coalesce(cast(doc_id as varchar), '') as id, {low} as run from (select doc_id, unnest(regexp_extract_all(text, '{run}')) as run from documents)),
k as (select id, run, count(*) as k from o group by id, run),
h as (select run, k, xor(list_reduce(list_concat([4294967295], flatten({code.format("id || ':' || run")})), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from k, crc),
v as (select word, cast(sum(k) as bigint) as n from (select k, case when h % 199 = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word from h) where length(word) >= 6 group by word having sum(k) >= 5),
x as (select word, n, p, substring(word, 1, p) || substring(word, p + 2) as rest from (select word, n, unnest(range(0, length(word))) as p from v)),
near as (select distinct x.word as word, v.word as near from x join v on v.word = x.rest union select distinct v.word, x.word from x join v on v.word = x.rest union select distinct a.word, b.word from x a join x b on a.rest = b.rest and a.p = b.p and a.word <> b.word),
best as (select near.word as word, count(*) as n_near, first(near order by v.n desc, encode(near)) as form, max(v.n) as form_n from near join v on v.word = near.near group by near.word),
j as (select v.word as word, n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from v left join best on best.word = v.word),
up(word, top) as (select word, word from j union select up.word, j.form from up join j on j.word = up.top where j.form is not null)
select j.word as word, j.form as form, up.top as root, j.n as n, j.n_near as n_near, j.form_n as form_n from j join up on up.word = j.word join j e on e.word = up.top where e.form is null"""


ORACLE_SQL = {"op1_decontaminate": _op1(), "op2_substring_dedup": _op2(), "op4_quality_rules": _op4(), "op5_secrets": _op5(), "op7_near_duplicates": _op7(), "op8_url_filter": _op8(), "op12_lexical_search": _op12(), "op13_spelling": _op13()}
