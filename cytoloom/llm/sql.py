"""DuckDB SQL that says the same as the queries, written from their definitions rather than their methods."""

from __future__ import annotations

from cytoloom.llm import licenses
from cytoloom.llm.tables import A_TO_Z

_LOWER = f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = """
with recursive steps (byte, k, c) as (
  select b, 0, b from range(256) t(b)
  union all select byte, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where k < 8),
crc as (select list(c order by byte) as t from steps where k = 8),
d as (select doc_id, coalesce(text, '') as text from documents),
h as (select doc_id, text, hex(encode(text)) as hx from d),
sized as (
  select doc_id, cast(strlen(text) + 1 as bigint) as size,
   case when text = '' then 0 else xor(4294967295, list_reduce(
     list_prepend(cast(4294967295 as bigint), list_transform(range(0, len(hx) // 2),
       lambda i: cast(16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1 as bigint))),
     lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) end as text_crc32
  from h, crc),
placed as (
  select *, sum(size) over (order by doc_id nulls first) - size as before, sum(size) over () as everything from sized),
cut as (select *, least(7, cast((2 * before + size) * 8 as hugeint) // (2 * everything)) as shard from placed)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, cast(shard as int) as shard,
 cast(row_number() over (partition by shard order by doc_id nulls first) - 1 as bigint) as slot, cast(null as int) as grown_shard
from cut"""

_TEMPLATES = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(licenses.TEMPLATES.items()))

OP2 = f"""
with t as (select name, {_ALNUM} as w from (values {_TEMPLATES}) v(name, text)),
ts as (select distinct name, list_slice(w, i, i + 4) as s from t, unnest(range(1, len(w) - 3)) u(i)),
d as (select row_number() over () as r, doc_id, {_ALNUM} as w from documents),
ds as (select r, doc_id, i - 1 as spot, list_slice(w, i, i + 4) as s from d, unnest(range(1, len(w) - 3)) u(i)),
hit as (
  select r, doc_id, name, count(distinct ds.s) as n_shared, min(spot) as first_word, max(spot) + 4 as last_word
  from ds join ts on ds.s = ts.s group by r, doc_id, name),
n as (select name, count(*) as n_template from ts group by name)
select doc_id, name as license, cast(n_template as int) as n_template, cast(n_shared as int) as n_shared,
 cast(first_word as int) as first_word, cast(last_word as int) as last_word
from hit join n using (name) where n_shared >= 0.8 * n_template"""

OP3 = f"""
with b as (select cast(item_id as varchar) as item_id, {_ALNUM} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, list_slice(w, i, i + least(len(w), 10) - 1) as s
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0),
lens as (select distinct len(s) as n from win),
d as (select row_number() over () as r, doc_id, coalesce({_ALNUM}, []) as w from documents),
run as (select r, i, n, list_slice(w, i, i + n - 1) as s from d, lens, unnest(range(1, len(w) - n + 2)) u(i)),
hit as (select r, i, n, item_id from run join win on run.s = win.s),
n_hit as (select r, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) u(p) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
 cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n_hit using (r) left join items using (r)"""

OP4 = rf"""
with recursive d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
sh as (
  select distinct r, array_to_string(list_slice(w, i, i + 3), ' ') as s
  from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(i) where len(w) > 0),
n as (select r, count(*) as n from sh group by r),
common as (select a.r as a, b.r as b, count(*) as k from sh a join sh b on a.s = b.s and a.r < b.r group by all),
link as (
  select a, b from common join n x on x.r = a join n y on y.r = b where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach (r, o) as (select a, a from edge union select reach.r, edge.b from reach join edge on edge.a = reach.o),
least as (select reach.r, min(d.doc_id) as o from reach join d on d.r = reach.o group by reach.r)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(o, doc_id) as component_id
from d left join n using (r) left join least using (r)"""

OP7 = """
with e as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id,
   cast(list_dot_product(cast(q.v as double[]), cast(d.v as double[])) as bigint) as score
  from e q join e d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""



def _add(path: str, cost, edits: str) -> str:
    """Paths are strings: nine digits of cost, then edits; so the least string is the cheapest path, ties by edits."""
    return f"(lpad(cast(cast(substr({path}, 1, 9) as int) + {cost} as varchar), 9, '0') || substr({path}, 10) || '{edits}')"


_BEFORE_U = "least(t0, t1, t3)"
_ROW = f"""
  {_add('t0', 3, 'D')} as s0,
  least({_add('t1', 3, 'D')}, case when not must and ini = 's' then {_add('t0', 'extra', 'K')} end) as s1,
  least({_add('t2', 3, 'D')}, case when must then null when ini = 'u' then {_add(_BEFORE_U, 'extra', 'K')}
    else {_add(_BEFORE_U, '2 + extra', 'R')} end) as s2,
  least({_add('t3', 3, 'D')}, case when must then null when ini = 'a' then {_add('t2', 'extra', 'K')}
    else {_add('t2', '2 + extra', 'R')} end) as s3"""

OP11 = rf"""
with recursive steps (byte, k, c) as (
  select b, 0, b from range(256) t(b)
  union all select byte, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where k < 8),
crc as (select list(c order by byte) as t from steps where k = 8),
c as (select row_number() over () as r, * from conversations),
hx as (select r, hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) as hx from c),
kind as (
  select r, xor(4294967295, list_reduce(
     list_prepend(cast(4294967295 as bigint), list_transform(range(0, len(hx) // 2),
       lambda i: cast(16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1 as bigint))),
     lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) % 20 as kind from hx, crc),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
    case when kind in (0, 1) then '' when kind = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text
  from c join kind using (r), unnest(case when kind = 0 then [] when kind = 3 then [0, 1] else [0] end) u(copy)),
e as (
  select *, dense_rank() over (order by conv_id nulls first) as g,
    row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again from d),
o as (select *, row_number() over (partition by g order by turn nulls first, role, text, again) as i from e),
f as materialized (
  select g, i, conv_id, turn, role, text, left(role, 1) as ini,
    case when not regexp_matches(text, '[^ 	-
]') then 'blank' when again then 'duplicate'
      when not regexp_matches(text, '[.!?][ 	-
]*\z') then 'truncated' else 'none' end as fault from o),
walk (g, i, s0, s1, s2, s3) as (
  select distinct g, cast(0 as bigint), '000000000', cast(null as varchar), cast(null as varchar), cast(null as varchar) from f
  union all
  select g, i + 1, s0, s1, s2, s3 from (
    select g, i, {_ROW}
    from (select *, least(s3, {_add('t2', 2, 'I')}) as t3 from (select w.g, w.i, s0 as t0, s1 as t1, s3,
        least(s2, {_add('s0', 2, 'I')}, {_add('s1', 2, 'I')}, {_add('s3', 2, 'I')}) as t2, ini, fault in ('blank', 'duplicate') as must,
        case when fault = 'truncated' then 1 else 0 end as extra
      from walk w join f on f.g = w.g and f.i = w.i + 1) p) q) n),
ends as (select g, max(i) as n from f group by g),
best as (
  select g, least(s0, s3, {_add('s2', 2, 'I')}, {_add('s0', 4, 'II')}, {_add('s1', 4, 'II')}) as path
  from walk join ends using (g) where i = n),
edits as (
  select g, p, substr(path, 9 + p, 1) as e from (select g, path, unnest(range(1, length(path) - 8)) as p from best) x),
placed as (
  select *, sum(case when e = 'I' then 0 else 1 end) over (partition by g order by p) as i,
    sum(case when e = 'D' then 0 else 1 end) over (partition by g order by p) as k from edits),
whole as (
  select placed.g, p, e, k, role, text, coalesce(max(case when k = 1 and e = 'K' and ini = 's' then 1 end) over (partition by placed.g), 0) as s
  from placed left join f on f.g = placed.g and f.i = placed.i and e <> 'I'),
fixed as (
  select g, string_agg(case when e = 'K' then role when (k - s) % 2 = 1 then 'user' else 'assistant' end || ':' ||
    case when e = 'I' then '' else text end, chr(10) order by p) as body from whole where e <> 'D' group by g),
pairs as (
  select g, count(*) as illegal from (select g, lag(ini) over (partition by g order by i) || ini as two from f) x
  where two is not null and two not in ('su', 'ua', 'au') group by g),
stats as (
  select g, any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    sum(case when fault = 'blank' then 1 else 0 end) as blank, sum(case when fault = 'duplicate' then 1 else 0 end) as duplicate,
    sum(case when fault = 'truncated' then 1 else 0 end) as truncated from f group by g),
done as (
  select conv_id, gaps, blank, duplicate, truncated, coalesce(illegal, 0) as illegal, cast(substr(path, 1, 9) as int) as cost,
    substr(path, 10) as audit, sha256(coalesce(body, '')) as repaired_sha256
  from stats join best using (g) left join fixed using (g) left join pairs using (g))
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank,
 cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
 cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit,
 coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join done on c.conv_id is not distinct from done.conv_id"""

CHECKS = {"op11_conversations": OP11, "op7_topk": OP7, "op4_ngram_join": OP4, "op1_sharding": OP1, "op2_licenses": OP2, "op3_decontam": OP3}
