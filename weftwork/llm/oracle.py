"""SQL (DuckDB) for the queries whose whole result SQL can express at the size where results are compared."""

from __future__ import annotations

from .license_scan import TERM
from .license_templates import TEMPLATES

OP4 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
fine as (select vec_id, e from v where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a)
select vec_id, (select count(*) from links where links.a = v.vec_id) as n_links, (select min(b) from reach where reach.a = v.vec_id) as component_id, vec_id = (select min(b) from reach where reach.a = v.vec_id) as kept from v
"""

OP7 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)),
hit as (select doc_id, i from windows where h in (select h from windows group by h having count(*) > 1)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from hit),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) as text, count(*) as n from each where not exists (select 1 from gone where gone.doc_id = each.doc_id and gone.j = each.j) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

_VALUES = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))

#: Every sentence and every whole text against every template: no leading terms here.
OP3 = f"""
with t(template, license, body) as (values {_VALUES}),
model as (select template, license, term, count(*) as tf from (select template, license, unnest(regexp_extract_all(lower(body), '{TERM}')) as term from t) group by all),
files as (select doc_id, concat_ws('/', source, lang, cast(doc_id as varchar)) as path, concat_ws('/', source, lang) as dir, text from documents),
total as (select count(*) as n from files),
df as (select term, count(*) as df from (select unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) as term from files) where term in (select term from model) group by term),
idf as (select term, ln((total.n + 1.0) / (coalesce(df.df, 0) + 1.0)) + 1.0 as idf from (select distinct term from model) left join df using (term), total),
cut as (select doc_id, path, list_concat([text], string_split(regexp_replace(text, '([.!?])[ \t]+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10))) as parts from files where text is not null),
units as (select doc_id, path, unnest(parts) as unit, unnest(range(0, len(parts))) as n from cut),
words as (select unit, term, count(*) as tf from (select unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) as term from (select distinct unit from units)) group by all),
w as (select unit, term, (1.0 + ln(tf)) * coalesce(idf.idf, ln(total.n + 1.0) + 1.0) as w from words left join idf using (term), total),
m as (select template, license, term, (1.0 + ln(tf)) * idf as v from model join idf using (term)),
mn as (select template, sqrt(sum(v * v)) as norm from m group by template),
wn as (select unit, sqrt(sum(w * w)) as norm from w group by unit),
cosine as (select w.unit, m.template, m.license, round(sum(w.w * m.v / mn.norm) / any_value(wn.norm), 6) as similarity from w join m using (term) join mn using (template) join wn on wn.unit = w.unit group by 1, 2, 3),
best as (select * from cosine where similarity >= 0.6 qualify row_number() over (partition by unit order by similarity desc, template) = 1),
found as (select doc_id, path, n, template, license, similarity from units join best using (unit)),
own as (select doc_id, path, license, similarity from found qualify row_number() over (partition by doc_id, path order by similarity desc, template, n) = 1),
whole as (select distinct doc_id, path from found where n = 0),
held as (select regexp_replace(path, '/[^/]*$', '') as up, min(path) as path, arg_min(license, path) as license from own join whole using (doc_id, path) group by 1),
heir as (select d.dir, arg_max(held.license, len(held.up)) as license, arg_max(held.path, len(held.up)) as path from (select distinct dir from files) d join held on d.dir = held.up or starts_with(d.dir, held.up || '/') group by d.dir)
select f.doc_id, f.path, coalesce(own.license, heir.license) as license, case when own.license is not null then 'own' when heir.license is not null then 'inherited' else 'none' end as how, own.similarity, case when own.license is not null then f.path else heir.path end as license_path from files f left join own on own.doc_id = f.doc_id left join heir on heir.dir = f.dir
"""



def _time(y: str) -> str:
    """The inverse of the three schedules' integrals at share ``y``."""
    late = f"0.5 + 2.0 * ({y} - 0.3125) / (0.75 + sqrt(0.5625 + 5.0 * ({y} - 0.3125)))"
    return f"case kind when 0 then 10.0 * {y} / (7.5 + sqrt(greatest(0.0, 56.25 - 50.0 * {y}))) when 1 then {y} else case when {y} < 0.3125 then 2.0 * {y} / (0.5 + sqrt(0.25 + {y})) else {late} end end"


#: The level of the caps by running sums in the order of cap / weight.
OP11 = f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
k as (select *, (row_number() over (order by source nulls last) - 1) % 3 as kind, 1.5 * sum(source_size) over () as total from s),
w as (select *, 2 * source_size as cap, (case kind when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight from k),
o as (select *, row_number() over (order by cap / weight, source nulls last) as nth from w),
l as (select *, (total - coalesce(sum(cap) over (order by nth rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by nth rows between current row and unbounded following) as level from o),
t as (select source, kind, source_size, least(cap::double, weight * (select arg_min(level, nth) from l where cap > weight * level)) as target from l),
p as (select d.*, t.kind, t.source_size, t.target, floor(t.target)::bigint as goal, coalesce(sum(d.size) over (partition by d.source order by md5(cast(d.doc_id as varchar)) nulls first, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as begun from d join t on d.source is not distinct from t.source),
y as (select *, greatest(0, least(size, goal - begun)) as t1, greatest(0, least(size, goal - begun - source_size)) as t2, begun::double / goal as y1, (begun + source_size)::double / goal as y2 from p)
select doc_id, size, source_size, target, cast(t1 + t2 as bigint) as taken, round(case when t1 > 0 then {_time("y1")} end, 9) as position, round(case when t2 > 0 then {_time("y2")} end, 9) as next_position from y
"""

OP12 = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
each as (select * from (select lang, unnest(w) as a, unnest(list_concat(w[2:], [null])) as b, unnest(list_concat(w[3:], [null, null])) as c from w) where a is not null),
n as (select lang, count(*) as n from each group by 1),
f1 as (select lang, a as p, count(*) as f from each group by 1, 2),
f2 as (select lang, a, b, count(*) as f from each where b is not null group by 1, 2, 3 having count(*) >= 10),
f3 as (select lang, a, b, c, count(*) as f from each where c is not null group by 1, 2, 3, 4 having count(*) >= 10),
c2 as (select f2.lang, f2.a || ' ' || f2.b as phrase, f2.f as a, l.f as l, r.f as r, 1 as k from f2 join f1 l on l.lang = f2.lang and l.p = f2.a join f1 r on r.lang = f2.lang and r.p = f2.b where not exists (select 1 from f3 where f3.lang = f2.lang and 100 * f3.f >= 50 * f2.f and ((f3.a = f2.a and f3.b = f2.b) or (f3.b = f2.a and f3.c = f2.b)))),
c3 as (select f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c as phrase, f3.f as a, l.f as l, r.f as r, 1 as k from f3 join f1 l on l.lang = f3.lang and l.p = f3.a join f2 r on r.lang = f3.lang and r.a = f3.b and r.b = f3.c union all select f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, l.f, r.f, 2 from f3 join f2 l on l.lang = f3.lang and l.a = f3.a and l.b = f3.b join f1 r on r.lang = f3.lang and r.p = f3.c),
s as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from (select * from c2 union all select * from c3)),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best qualify rank <= 2000)
select lang, rank, phrase, a, l, r, n, score from top join n using (lang)
"""

SQL = {"op11_mixing": OP11, "op12_collocations": OP12, "op3_licenses": OP3, "op4_embedding_dups": OP4, "op7_substrings": OP7}
