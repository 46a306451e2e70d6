"""Results of those queries that SQL can express, in DuckDB SQL: exact pairs, windows and sums where the jobs use indexes,
signatures and bounded passes."""

from __future__ import annotations

from helixlake.llm.licences import LICENCE_LINE, LICENCE_NAME, TEMPLATES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = rf"""with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t, text is not null as there, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
windows as (select r, unnest(range(1, len(w) - 6)) as k, w from d where len(w) > 8),
joined as (select r, k, array_to_string(w[k:k + 7], ' ') as win from windows),
twice as (select r, k from joined join (select r, win from joined group by all having count(*) > 1) using (r, win)),
again as (select r, count(distinct p) as n from (select r, unnest(range(k, k + 8)) as p from twice) group by r),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, {WORD}) group by r),
base as (select d.r, doc_id, lang, there, t, w, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(lines.n, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words from d left join lines using (r) left join again using (r)),
ascii as (select r, lang, there, strlen(t) as bytes, [len(regexp_replace(t, '[^a-z]', '', 'g')), len(regexp_replace(t, '[^A-Z]', '', 'g')), len(regexp_replace(t, '[^0-9]', '', 'g')), len(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')),
  len(regexp_replace(t, '[^.,;:!?]', '', 'g')), len(regexp_replace(t, '[^''"()\[\]{{}}]', '', 'g')), len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))] as c, len(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as low from base),
classes as (select r, lang, there, unnest(range(1, 10)) as k, unnest(list_transform(c || [low - list_sum(c), bytes - low], lambda x: x / bytes)) as p from ascii where bytes > 0),
class_ref as (select lang, k, s / sum(s) over (partition by lang) as q from (select lang, k, sum(p) as s from classes where lang is not null and there group by all)),
by_class as (select r, f.lang, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as a
  from classes c join class_ref f using (k) group by all),
bare as (select r, lang, trim(translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?''"()[]{{}}') as word from base),
totals as (select lang, count(*) as total from bare where lang is not null group by 1),
common as (select lang, word, count(*) / max(total) as q from bare join totals using (lang) where word <> '' group by all having count(*) >= 0.005 * max(total)),
own as (select r, word, count(*) as n from bare group by all),
shares as (select b.r, c.lang, c.word, c.q, coalesce(o.n, 0) / b.n_words as p from (select r, n_words from base where n_words > 0) b cross join common c left join own o on o.r = b.r and o.word = c.word),
whole as (select r, lang, p, q from shares union all select r, lang, greatest(0, 1 - sum(p)), 1 - sum(q) from shares group by all),
by_word as (select r, lang, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as b from whole group by all),
nearest as (select r, arg_min(struct_pack(a := a, b := b), (a + b, lang)) as x from by_class join by_word using (r, lang) group by r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(x.a, 0) <= 0.28 and (n_words < 100 or coalesce(x.b, 0) <= 0.3) as kept,
  round(coalesce(x.a, 0), 6) as class_distance, round(coalesce(x.b, 0), 6) as word_distance
from base left join nearest using (r)"""

_values = ", ".join(f"({k}, '{name}', '{wording.replace(chr(39), chr(39) * 2)}')" for k, (name, wording) in enumerate(TEMPLATES))
_blank = "coalesce(nullif(list_position(list_transform(l, lambda x: trim(x, ' ') = ''), true), 0), len(l) + 1)"

OP5 = rf"""with files as (select doc_id, text, concat_ws('/', coalesce(source, 'unknown'), cast(doc_id // 1000 as varchar), cast(doc_id // 50 as varchar), cast(doc_id as varchar)) as path from documents),
templates as (select k as template, licence, regexp_extract_all(lower(wording), '[a-z0-9]+') as w from (values {_values}) v(k, licence, wording)),
vocabulary as (select distinct unnest(w) as term from templates),
n as (select count(*) as n from files),
df as (select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from files) join vocabulary using (term) group by 1),
idf as (select term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 as idf from vocabulary left join df using (term) cross join n),
parted as (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as l from files where regexp_matches(text, '{LICENCE_LINE}')),
units as (select doc_id, array_to_string(l, chr(10)) as wording from parted union select doc_id, array_to_string(l[1:{_blank} - 1], chr(10)) from parted
  union select doc_id, array_to_string(l[i:i + n - 1], chr(10)) from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from parted), (values (1), (2), (3)) v(n) where regexp_matches(l[i], '{LICENCE_LINE}')),
numbered as (select row_number() over () as unit, doc_id, regexp_extract_all(lower(wording), '[a-z0-9]+') as w from units),
terms as (select unit, doc_id, term, tf, tf * coalesce(idf, ln(1 + n) + 1) as v from (select unit, doc_id, term, count(*) as tf from (select unit, doc_id, unnest(w) as term from numbered) group by all) left join idf using (term) cross join n),
norms as (select unit, sqrt(sum(v * v)) as norm, sum(tf) as words from terms group by 1),
models as (select template, licence, term, tf * idf as m from (select template, licence, term, count(*) as tf from (select template, licence, unnest(w) as term from templates) group by all) join idf using (term)),
lengths as (select template, sqrt(sum(m * m)) as length from models group by 1),
scored as (select doc_id, unit, licence, round(sum(v * m) / (max(norm) * max(length)), 6) as similarity, max(words) as words from terms join models using (term) join norms using (unit) join lengths using (template) group by doc_id, unit, template, licence),
owns as (select doc_id, licence, similarity, words from (select *, row_number() over (partition by doc_id order by similarity desc, licence, words desc) as k from scored where similarity >= 0.7) where k = 1),
named as (select f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as all_words, o.licence as own, similarity, words from files f left join owns o using (doc_id)),
by_dir as (select dir, licence, similarity from (select dir, own as licence, similarity, row_number() over (partition by dir order by similarity desc, own) as k from named
  where own is not null and path is not null and (regexp_matches(path, '{LICENCE_NAME}') or words >= 0.5 * all_words)) where k = 1),
near as (select n.doc_id, arg_max(struct_pack(dir := b.dir, licence := b.licence, similarity := b.similarity), len(b.dir)) as x from named n join by_dir b on n.own is null and (n.dir = b.dir or starts_with(n.dir, b.dir || '/') or b.dir = '') group by 1)
select doc_id, path, coalesce(own, x.licence) as licence, case when own is not null then 'own' when x is not null then 'inherited' else 'none' end as origin, coalesce(similarity, x.similarity) as similarity,
  case when own is null then x.dir end as licence_dir from named left join near using (doc_id)"""

OP7 = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, {WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, node) as (select doc_id, doc_id from d union select r.doc_id, e.b from reach r join ways e on e.a = r.node),
least_node as (select doc_id, min(node) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_node left join sizes using (doc_id)"""

OP10 = rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, {TERM}) as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, {TERM}) as w from benchmark),
windows as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[k:k + 12], ' ') as win from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from b where len(w) > 0)),
own as (select r, n, k, array_to_string(w[k:k + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from windows) where len(w) >= n)),
hits as (select r, n, k, item_id from own join windows using (n, win)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hits) group by 1),
items as (select r, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct r, cast(item_id as varchar) as i from hits where item_id is not null) group by 1),
item_words as (select distinct item_id, unnest(w) as word from b where item_id is not null),
rarest as (select item_id, word, row_number() over (partition by item_id order by n, word) as rank from item_words join (select word, count(*) as n from item_words group by 1) using (word) qualify rank <= 4),
needed as (select item_id, count(*) as n from rarest group by 1),
pos as (select p.r, p.k, word from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d) p where word in (select word from rarest)),
first as (select r, k, item_id from pos join rarest using (word) where rank = 1),
met as (select f.r, f.k, f.item_id, count(distinct q.word) as n from first f join rarest t using (item_id) join pos q on q.r = f.r and q.word = t.word and abs(q.k - f.k) <= 26 group by all),
near as (select r, count(distinct item_id) as near_items from met join needed using (item_id, n) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
  coalesce(near_items, 0) as near_items from d left join hit using (r) left join items using (r) left join near using (r)"""

OP12 = rf"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
parts as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from parts group by 1),
runs as (select lang, g, array_to_string(w[k:k + g - 1], ' ') as phrase from (select lang, w, g, unnest(range(1, len(w) - g + 2)) as k from parts, (select unnest(range(1, 6)) as g) where len(w) >= g)),
counted as (select lang, g, phrase, count(*) as f from runs group by all having count(*) >= 100),
candidates as (select lang, g, phrase, f as a, string_split(phrase, ' ') as w from counted where g > 1),
inside as (select lang, phrase, max(a) as longer from (select lang, a, array_to_string(w[k:k + m - 1], ' ') as phrase from (select lang, a, w, m, unnest(range(1, g - m + 2)) as k from candidates, (select unnest(range(2, 5)) as m) where m < g)) group by all),
own as (select c.* from candidates c left join inside i using (lang, phrase) where i.longer is null or 100 * i.longer < 100 * c.a),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:g], ' ') as rest from (select *, unnest(range(1, g)) as k from own)),
scored as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n, cast((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as bigint) as score from cuts c join counted x on x.lang = c.lang and x.phrase = c.head
  join counted y on y.lang = c.lang and y.phrase = c.rest join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best qualify rank <= 2000"""

#: The same join at another threshold, without a choice among members.
OP11 = OP7.replace("100 * c >= 75 *", "100 * c >= 80 *").replace(", doc_id = component_id as kept", "")

ORACLE_SQL = {"op11_ngram_join": OP11, "op12_collocations": OP12, "op2_quality": OP2, "op5_licences": OP5, "op7_near_duplicates": OP7, "op10_decontaminate": OP10}
