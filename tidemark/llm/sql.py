"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, length(role) + length(regexp_replace(role, '[^<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^<\[]', '', 'g')) + 24 as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id"""

OP4 = rf"""
with t as (select doc_id, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as ws from documents),
n as (select doc_id, ws, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, m, i, list_slice(ws, i, i + m - 1) as gram from (select doc_id, ws, m, unnest(generate_series(1, n_words - m + 1)) as i from n cross join (values (3), (10), (51)) v(m) where n_words >= m)),
again as (select doc_id, m, i from g qualify count(*) over (partition by doc_id, m, gram) > 1),
cover as (select doc_id, m, sum(least(m, coalesce(nxt - i, m))) as words from (select *, lead(i) over (partition by doc_id, m order by i) as nxt from again) group by 1, 2),
c as (select n.*, coalesce((select words from cover x where x.doc_id = n.doc_id and m = 3), 0) as r3, coalesce((select words from cover x where x.doc_id = n.doc_id and m = 10), 0) as r10,
  exists (select 1 from cover x where x.doc_id = n.doc_id and m = 51) as long from n)
select doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, cast(r3 as bigint) as n_repeat_words, n_words < 50 or 100 * r3 > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * r3 > 50 * n_words) and r10 <= 0.2 * n_words and not long as kept from c"""

OP7 = rf"""
with d as (select doc_id, source, len({WORDS.format("coalesce(text, '')")}) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
o as (select *, row_number() over (order by 3.0 * source_size / weight, source) as k from w),
l as (select *, ((select sum(source_size) from s) - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)) / cast(sum(weight) over (order by k rows between current row and unbounded following) as double) as level from o),
t as (select *, least(coalesce((select min_by(level, k) from l where level * weight <= 3 * source_size), 1e300) * weight, 3.0 * source_size) as target from l),
p as (select d.*, t.weight, t.source_size, t.target, cast(round(t.target) as bigint) as goal, cast(sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size as bigint) as place from d join t on d.source is not distinct from t.source),
q as (select *, place / greatest(target, 1.0) as x, greatest(0, least(size, goal - place)) as w1, greatest(0, least(size, goal - source_size - place)) as w2, greatest(0, least(size, goal - 2 * source_size - place)) as w3 from p),
v as (select *, greatest(x - 0.375, 0.0) as y from q)
select doc_id, size, source_size, target, w1 + w2 + w3 as taken,
  round(case when x >= 1.0 then 1.0 when weight = 1 then 2 * x / (1.5 + sqrt(greatest(2.25 - 2 * x, 0.0))) when weight = 2 then x
    when x < 0.375 then 2 * x / (0.5 + sqrt(0.25 + 2 * x)) else 0.5 + 2 * y / (1.0 + sqrt(1.0 + 2 * y)) end, 9) as position,
  cast(w1 > 0 as bigint) + cast(w2 > 0 as bigint) + cast(w3 > 0 as bigint) as passes
from v"""

OP10 = rf"""
with recursive t as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
sh as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as s from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from t where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (select doc_id, doc_id from t union select e.b, r.root from reach r join edges e on e.a = r.doc_id where r.root < e.b),
comp as (select doc_id, min(root) as component_id from reach group by 1)
select t.doc_id, coalesce(n, 0) as n_shingles, component_id, t.doc_id = component_id as kept from t left join n using (doc_id) join comp using (doc_id)"""

SQL = {"op3_chat_formatting": OP3, "op4_quality_rules": OP4, "op7_curriculum_mixing": OP7, "op10_minhash_near_dedup": OP10}
