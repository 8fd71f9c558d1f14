"""DuckDB SQL for the queries that SQL can express, by plain brute force."""

from __future__ import annotations

from .mixing import MAX_EPOCHS, WEIGHTS
from .secrets import BASE, RULES
from .warc import OP6_SQL

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = f"""
with d as (select doc_id, {_WORDS} w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) j from d),
k as (select doc_id, j, w[j] word, case when j + 49 <= len(w) then md5(array_to_string(w[j:j + 49], ' ')) end win from p),
f as (select win, min(doc_id) first_id from k where win is not null group by 1),
m as (select k.doc_id, k.j, k.word, coalesce(f.first_id < k.doc_id, false) again from k left join f using (win)),
c as (select doc_id, j, word, bool_or(again) over (partition by doc_id order by j rows between 49 preceding and current row) gone from m)
select d.doc_id, len(any_value(d.w)) as n_words, count(*) filter (c.gone) as n_removed, sha256(coalesce(string_agg(c.word, ' ' order by c.j) filter (not c.gone), '')) as kept_sha256
from d left join c using (doc_id) group by d.doc_id
"""

#: Components of the links ``l`` (a, b) among the rows ``v`` (id).
_REACH = """r(id, low) as (select id, id from v union select l.b, r.low from r join l on l.a = r.id where r.low < l.b)"""

OP3_SQL = f"""
with recursive v as (select vec_id id, embedding::double[] e from embeddings),
u as (select * from v where len(e) > 0 and list_sum(list_transform(e, lambda x: x * x)) > 0 and not list_bool_or(list_transform(e, lambda x: x is null or not isfinite(x)))),
l as (select p.id a, q.id b from u p join u q on p.id <> q.id and len(p.e) = len(q.e) and list_cosine_similarity(p.e, q.e) >= 0.9),
{_REACH},
c as (select id, min(low) component_id from r group by 1), n as (select a id, count(*) n from l group by 1)
select v.id as vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.id = c.component_id as kept from v join c on c.id = v.id left join n on n.id = v.id
"""

OP8_SQL = f"""
with recursive v as (select doc_id id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from v),
x as (select id, unnest(g) t from s),
k as (select p.id a, q.id b, count(*) n from x p join x q on p.t = q.t and p.id <> q.id group by 1, 2),
l as (select a, b from k join s p on p.id = a join s q on q.id = b where 100 * n >= 75 * (len(p.g) + len(q.g) - n)),
{_REACH},
c as (select id, min(low) component_id from r group by 1)
select s.id as doc_id, len(s.g)::bigint as n_shingles, c.component_id, s.id = c.component_id as kept from s join c using (id)
"""


def _rule(k: int) -> str:
    pattern = RULES[k][1].replace("'", "''")
    keep = f"length(regexp_extract(h[k], '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8" if k == 0 else "true"
    begin = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0)"
    return f"""select doc_id, {k} as rank, '{RULES[k][0]}' as kind, ({begin})::bigint as a, ({begin} + length(h[k]))::bigint as b
    from (select doc_id, g, h, unnest(range(1, len(h) + 1)) k from (select doc_id, string_split_regex(t, '{pattern}') g, regexp_extract_all(t, '{pattern}') h from d)) where {keep}"""


OP7_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
s as ({' union all '.join(_rule(k) for k in range(len(RULES)))}),
o as (select *, kind || ':' || a || ':' || b as span from s)
select d.doc_id, {', '.join(f"count(*) filter (o.kind = '{kind}') as n_{kind}" for kind in BASE)},
    sha256(coalesce(string_agg(span, ',' order by a, rank) filter (rank < {len(BASE)}), '')) as base_sha256, coalesce(string_agg(span, ',' order by a, rank), '') as spans
from d left join o using (doc_id) group by d.doc_id
"""

OP10_SQL = f"""
with d as (select doc_id, source, len({_WORDS})::bigint size, ('0x' || left(md5(coalesce(doc_id::varchar, '') || ':17'), 15))::bigint h from documents),
s as (select source, sum(size)::bigint source_size, (case (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} {' '.join(f'when {k} then {w}' for k, w in enumerate(WEIGHTS))} end)::double w from d group by 1),
q as (select *, source_size * {float(MAX_EPOCHS)}::double lim from s),
y as (select *, (sum(source_size) over () - coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) lev from q),
z as (select *, first_value(case when lev * w <= lim then lev end ignore nulls) over (order by lim / w, source nulls last rows between unbounded preceding and unbounded following) fixed from y),
t as (select source, source_size, case when fixed is null then lim else least(lim, fixed * w) end target from z),
c as (select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by h, doc_id rows unbounded preceding) cum from d join t on t.source is not distinct from d.source),
e as (select *, (k * source_size + cum)::double / greatest(target, 1e-9) v from c, (select unnest(range(0, {MAX_EPOCHS})) k) where target > 0),
g as (select *, sum(size) over (order by v, h, doc_id rows unbounded preceding) total from e),
n as (select doc_id, h, count(*) copies from g where total <= (select round(sum(target), 3) from t) group by 1, 2)
select c.doc_id, c.size, c.source_size, c.target, (c.size * coalesce(n.copies, 0))::bigint as taken, c.source, coalesce(n.copies, 0)::bigint as copies from c left join n on n.doc_id = c.doc_id and n.h = c.h
"""

SQL = {
    "op2_fm_index_repeats": OP2_SQL, "op3_e8_lattice": OP3_SQL, "op6_revisit_resolution": OP6_SQL,
    "op7_blob_ledger_secrets": OP7_SQL, "op8_minhash_forest": OP8_SQL, "op10_weighted_fair_mix": OP10_SQL,
}
