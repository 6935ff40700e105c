"""DuckDB statements for the operators that SQL can express on the small tables."""

UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, n, x, unnest(generate_series(0, n - 200)) as i from t where n >= 200),
w as (select doc_id, i, md5(substr(x, 2 * i + 1, 400)) as h from p),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from w) where c > 1),
g as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from r),
s as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
u as (select doc_id, run, min(i) as a, max(i) + 200 as b from s group by doc_id, run),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before, lead(a) over (partition by doc_id order by a) as after_ from u),
d as (select k.doc_id, sum(b - a) as removed, count(*) as spans, string_agg(substr(t.x, 2 * before + 1, 2 * (a - before)) || case when after_ is null then substr(t.x, 2 * b + 1) else '' end, '' order by a) as kept from k join t using (doc_id) group by k.doc_id)
select t.doc_id, cast(t.n as bigint) as n_bytes, cast(coalesce(d.removed, 0) as bigint) as n_removed, cast(coalesce(d.spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(d.kept, t.x))) as kept_sha256
from t left join d using (doc_id)
"""

OP4 = f"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from t),
d as (select distinct doc_id, g from s),
n as (select doc_id, count(*) as n from d group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from d a join d b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select o.a, o.b from o join n x on x.doc_id = o.a join n y on y.doc_id = o.b where 100 * o.c >= 90 * (x.n + y.n - o.c)),
r as (select doc_id as node, doc_id as reach from documents union select r.node, e.b from r join e on e.a = r.reach),
m as (select node, min(reach) as component_id from r group by node)
select t.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from t left join n using (doc_id) join m on m.node = t.doc_id
"""

OP5 = r"""
with t as (select doc_id, text, case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end as x from documents),
l as (select doc_id, cast(unnest(generate_series(0, len(x) - 1)) as bigint) as i, unnest(x) as line from t),
c as (select doc_id, i, sum(greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))) over (partition by doc_id order by i) as upto, greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as n from l),
e as (select a.doc_id, a.i, min(b.i) as last from c a join c b on a.doc_id = b.doc_id and b.i between a.i and a.i + 50 and b.upto >= a.upto - a.n + 50 group by a.doc_id, a.i),
k as (select e.doc_id, e.i, e.last + 1 as stop, array_to_string(t.x[e.i + 1:e.last + 1], chr(10)) as key from e join t using (doc_id)),
f as (select key, min((doc_id, i)) as first, count(*) as n from k group by key having count(*) > 1),
g as (select k.doc_id, case when k.doc_id = f.first[1] then greatest(k.i, f.first[2] + k.stop - k.i) else k.i end as a, k.stop from k join f using (key) where k.doc_id <> f.first[1] or k.i <> f.first[2]),
d as (select distinct l.doc_id, l.i from l join g on g.doc_id = l.doc_id and l.i >= g.a and l.i < g.stop),
r as (select l.doc_id, count(d.i) as removed, string_agg(l.line, chr(10) order by l.i) filter (d.i is null) as kept from l left join d on d.doc_id = l.doc_id and d.i = l.i group by l.doc_id)
select t.doc_id, case when t.text is null then null else coalesce(r.kept, '') end as text, cast(len(t.x) as bigint) as n_lines, cast(coalesce(r.removed, 0) as bigint) as n_removed
from t left join r using (doc_id)
"""

OP6 = f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UP}) as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
r(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select h.page_id, r.rule_host || r.rule_path as rule, r.verdict, row_number() over (partition by h.page_id order by length(r.rule_host || r.rule_path) desc, length(r.rule_host) desc) as nth
  from h join r on (h.host = r.rule_host or ends_with(h.host, '.' || r.rule_host)) and starts_with(h.path, r.rule_path))
select h.page_id, coalesce(h.host, '') as host, coalesce(h.path, '') as path, m.rule, coalesce(m.verdict, 'allow') as verdict
from h left join m on m.page_id = h.page_id and m.nth = 1
"""

OP10 = f"""
with recursive q as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
p as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as key from (select item, w, least(10, len(w)) as m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from q where len(w) > 0)),
t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
v as (select distinct m from p),
d as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as key from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from t, v where len(w) >= m)),
h as (select d.doc_id, d.i, d.m, p.item from d join p on p.m = d.m and p.key = d.key),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + m - 1)) as j from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select t.doc_id, cast(len(t.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(s.n_items, 0) as bigint) as n_items, sha256(coalesce(s.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from t left join c using (doc_id) left join s using (doc_id)
"""

ORACLES = {"op3_suffix_dedup": OP3, "op4_ngram_join": OP4, "op5_line_dedup": OP5, "op6_url_filter": OP6, "op10_decontamination": OP10}
