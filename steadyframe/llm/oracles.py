"""DuckDB SQL for the training-data queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as id, {_WORDS} as w from benchmark where item_id is not null),
win as (select distinct id, n, g from (
  select id, least(len(w), 10) as n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g
  from b where len(w) > 0) x),
dg as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select d.*, s.n, unnest(range(1, len(w) - s.n + 2)) as i from d, (select distinct n from win) s) y),
hit as (select doc_id, i, n, id from dg join win using (n, g)),
words as (select doc_id, count(distinct p) as c from (select doc_id, unnest(range(i, i + n)) as p from hit) z group by doc_id),
items as (select doc_id, count(*) as k, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from hit) u group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(c, 0) as bigint) as n_hit, cast(coalesce(k, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(c, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

OP10 = f"""
with u as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, case
  when rule in ('example.net/en/', 'org/fr/') then 'allow'
  when rule is not null then 'block'
  when regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?(spam-farm|cheap-pills|free-casino|casino|adult-.*)\\.')
    or regexp_matches(lower(url), '/(wp-login|xmlrpc)\\.php([^a-z0-9%._-]|$)')
    or regexp_matches(lower(url), 'utm_source=spam([^a-z0-9%._-]|$)') then 'block' else 'allow' end as verdict
from r
"""


OP7 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
e as (select doc_id, o, substr(h, 2 * o + 1, 298) as h from (select doc_id, h, unnest(range(0, length(h) // 2, 100)) as o from d) v),
w as (select doc_id, o + i as i, substr(h, 2 * i + 1, 100) as g from (select doc_id, o, h, unnest(range(0, least(100, length(h) // 2 - 49))) as i from e) x),
m as (select g, min(doc_id) as least from w group by g having count(distinct doc_id) > 1),
f as (select w.doc_id, w.i as p from w join m using (g) where least < w.doc_id),
pos as (select doc_id, o + p as p, substr(h, 2 * p + 1, 2) as b from (select doc_id, o, h, unnest(range(0, least(100, length(h) // 2))) as p from e) y),
c as (select pos.doc_id, pos.p, b, max((f.p is not null)::int) over (partition by pos.doc_id order by pos.p rows between 49 preceding and current row) as gone
  from pos left join f on f.doc_id = pos.doc_id and f.p = pos.p),
r as (select *, coalesce(lag(gone) over (partition by doc_id order by p), 0) as before from c),
k as (select doc_id, cast(sum(gone) as bigint) as n, count(*) filter (gone = 1 and before = 0) as s, string_agg(b, '' order by p) filter (gone = 0) as k from r group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n, 0) as n_removed, coalesce(s, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from d left join k using (doc_id)
"""

#: The plain patterns.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_TESTS = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: cast(p as hugeint) > 255)) = 0",
    "card": f"length({_DIGITS}) between 16 and 19 and list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: case when k % 2 = 0 then cast(substr(reverse({_DIGITS}), k, 1) as integer) * 2 // 10 + cast(substr(reverse({_DIGITS}), k, 1) as integer) * 2 % 10 else cast(substr(reverse({_DIGITS}), k, 1) as integer) end)) % 10 = 0",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _kind(kind: str, order: int) -> str:
    found = f"regexp_extract_all(t, '{_BASE[kind]}')"
    return f"""select rid, {order} as o, '{kind}' as kind, a, a + length(v) as b, v from (
  select rid, m[k] as v, cast(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as bigint) as a
  from (select rid, m, g, unnest(range(1, len(m) + 1)) as k from (select rid, {found} as m, string_split_regex(t, '{_BASE[kind]}') as g from d) e) f) h where {_TESTS[kind]}"""


#: Tokens and lexical patterns; DuckDB's regular expressions need no guard against long runs.
_RUN = r"[A-Za-z._+-]*[0-9@][A-Za-z0-9._@+-]*"
_LABEL = r"(\p{L}[\p{L}0-9_]{0,31})[ \t]{0,4}([:=])[ \t]{0,4}[\x22\x27]?\z"
_OPENING = r"\n[^\p{L}\p{N}]{0,4}(\p{L}+)[^\p{L}\p{N}\n]{1,4}\z"
_PAIR = r"(\p{L}+)[^\p{L}\p{N}]{1,4}(\p{L}+)[^\p{L}\p{N}]{1,4}\z"
_LABEL_USE = r"(\p{L}[\p{L}0-9_]{0,31})[ \t]{0,4}([:=])"
_OPENING_USE = r"^[^\p{L}\p{N}]{0,4}(\p{L}+)"


def _round(n: int) -> str:
    """Round n of the scores: patterns with three trusted instances, then instances by their best pattern."""
    return f"""
conf{n} as (select pattern, sum(g.n * x.score) / any_value(u.uses) as c from graph g join score{n - 1} x using (value) join uses u using (pattern)
  group by pattern having count(*) filter (x.score >= 0.5) >= 3),
score{n} as (select value, case when bool_or(known) then 1.0::double else least(coalesce(max(c), 0.0), 1.0) end as score from graph left join conf{n} using (pattern) group by value)"""


OP5 = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(_kind(k, n) for n, k in enumerate(_BASE))}),
runs as (select rid, k, v, sum(length(gap)) over w + sum(length(v)) over w - length(v) as a
  from (select rid, unnest(range(1, len(m) + 1)) as k, unnest(m) as v, unnest(g[1:len(m)]) as gap
    from (select rid, regexp_extract_all(t, '{_RUN}') as m, string_split_regex(t, '{_RUN}') as g from d) x) y window w as (partition by rid order by k)),
cores as (select rid, cast(a + length(regexp_extract(v, '^[._@+-]*')) as bigint) as a, regexp_extract(v, '[A-Za-z0-9](.*[A-Za-z0-9])?') as v from runs),
free as (select rid, a, a + length(v) as b, v from cores where length(v) >= 5 and regexp_matches(v, '[0-9@]')
  and not exists (select 1 from s where s.rid = cores.rid and s.a < cores.a + length(v) and cores.a < s.b)),
tokens as (select rid, a, b, v, false as base, regexp_matches(v, '^(AKIA|ASIA)[0-9A-Z]{{16}}\z') or regexp_matches(v, '^[0-9A-Fa-f]{{16,}}\z') and regexp_matches(v, '[A-Fa-f]') and regexp_matches(v, '[0-9]') as is_key, is_key as seed from free
  union all select rid, a, b, v, true, false, true from s),
lefts as (select tokens.*, lower(case when a <= 48 then chr(10) else '' end || substr(t, greatest(a - 47, 1)::bigint, least(a, 48)::bigint)) as l from tokens join d using (rid)),
named as (select *, case when regexp_extract(l, '{_LABEL}', 1) <> '' then regexp_extract(l, '{_LABEL}', 1) || regexp_extract(l, '{_LABEL}', 2)
  when regexp_extract(l, '{_OPENING}', 1) <> '' then '^' || regexp_extract(l, '{_OPENING}', 1)
  when regexp_extract(l, '{_PAIR}', 1) <> '' then regexp_extract(l, '{_PAIR}', 1) || ' ' || regexp_extract(l, '{_PAIR}', 2) else '' end as pattern from lefts),
edges as (select pattern, lower(v) as value, bool_or(seed) as seed, count(*) as n from named where pattern <> '' group by all),
seeds as (select distinct value from edges where seed),
graph as (select pattern, value, n, value in (select value from seeds) as known from edges where pattern in (select pattern from edges group by pattern having count(*) >= 3)),
holds as (select lower(t) as t from d where regexp_matches(t, '[0-9@]')),
used as (select unnest(list_transform(range(1, len(x) + 1), lambda k: x[k] || y[k])) as pattern from (select regexp_extract_all(t, '{_LABEL_USE}', 1) as x, regexp_extract_all(t, '{_LABEL_USE}', 2) as y from holds) q
  union all select '^' || w from (select regexp_extract(unnest(string_split(t, chr(10))), '{_OPENING_USE}', 1) as w from holds) q where w <> ''
  union all select unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) from (select string_split_regex(t, '[^\p{{L}}]+') as w from holds) q),
uses as (select pattern, greatest(sum(n), coalesce(any_value(c), 0)) as uses from graph left join (select pattern, count(*) as c from used group by pattern) z using (pattern) group by pattern),
score0 as (select value, case when bool_or(known) then 1.0::double else 0.0 end as score from graph group by value),{",".join(_round(n) for n in (1, 2, 3))},
good as (select pattern from conf3 where c >= 0.5),
found as (select rid, o, kind, a, b from s
  union all select rid, case when is_key then 4 else 5 end, case when is_key then 'key' else 'context' end, a, b from named where not base and (is_key or pattern in (select pattern from good))),
j as (select rid, string_agg(kind || ':' || a || ':' || b, ',' order by o, a) as x, string_agg(kind || ':' || a || ':' || b, ',' order by o, a) filter (o < 4) as base,
  {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in (*_BASE, "key", "context"))} from found group by rid)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in (*_BASE, "key", "context"))}, sha256(coalesce(base, '')) as base_sha256, coalesce(x, '') as spans from d left join j using (rid)
"""


OP11 = """
with v as (select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(256 * cast(x as double)))) = 0),
s as (select q.uid, q.vec_id as query_id, v.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, v.e, true), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by uid order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""


def _crc32(codes: str) -> str:
    """The CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, cast(4294967295 as bigint)), 4294967295)"


_H = _crc32("list_transform(range(1, length(cast(conv_id as varchar)) + 1), lambda k: cast(ord(substr(cast(conv_id as varchar), k, 1)) as bigint))") + " % 6"

OP12 = f"""
with own as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as w
  from conversations where conv_id is not null group by conv_id),
h as (select conv_id, w, {_H} as h from own),
c as (select h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) as w from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100),
p as (select conv_id, len(w) as n, unnest(range(0, len(w) + 1)) as depth, w from c),
k as (select conv_id, n, depth, w[1:depth] as g from p),
n as (select g, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from k group by g, depth),
t as (select n.*, m.conv_id as parent_conv_id, (n_convs - 1) * case when n.depth = 0 then 0 else length(n.g[n.depth].t) end as saved from n
  left join (select g as mg, depth as md, conv_id from n) m on md = n.depth - 1 and mg = n.g[1:n.depth - 1]),
f as (select g, depth, (select count(*) from t x where x.depth = t.depth + 1 and x.g[1:t.depth] = t.g) as n_children, conv_id, parent_conv_id, n_convs, saved, ends_sha256 from t)
select a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) filter (b.n_children = 0) as n_leaves, cast(sum(b.saved) as bigint) as saved_tokens, a.ends_sha256
from f a join f b on b.depth >= a.depth and b.g[1:a.depth] = a.g group by all
"""

_BYTES = "list_transform(range(0, length(hex(encode(w))) // 2), lambda k: cast((strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * k + 2, 1)) - 1 as bigint))"

OP13 = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
dw as (select rid, w, count(*) as n from (select rid, unnest(ws) as w from d) x group by rid, w),
bw as (select w, count(*) as n from (select unnest({_WORDS}) as w from benchmark) x group by w),
c as (select w, {_crc32(_BYTES)} % 10000 as bucket from (select w from dw union select w from bw) x),
s as (select bucket, sum(n) as s from dw join c using (w) group by bucket),
t as (select bucket, sum(n) as t from bw join c using (w) group by bucket),
g as (select bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) as double) + 1) * (cast(coalesce((select sum(s) from s), 0) as double) + 10000)
    / ((cast(coalesce(s, 0) as double) + 1) * (cast(coalesce((select sum(t) from t), 0) as double) + 10000)))) as bigint) as gain
  from (select distinct bucket from c) x left join s using (bucket) left join t using (bucket)),
k as (select rid, sum(dw.n * gain) as weight from dw join c using (w) join g using (bucket) group by rid),
h as (select rid, doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  list_reduce(list_transform(range(1, 9), lambda i: cast(strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), i, 1)) - 1 as bigint)), lambda a, b: a * 16 + b) as h
  from d left join k using (rid)),
z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from h),
r as (select rid, row_number() over (order by score desc, doc_id nulls last) as rank from z where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) from r) * 10 // 100 then rank end as rank from z left join r using (rid)
"""


def oracle_sql() -> dict[str, str]:
    own = {"op1_benchmark_decontamination": OP1, "op5_personal_data": OP5, "op7_suffix_dedup": OP7, "op10_url_filters": OP10}
    return own | {"op11_exact_top_k": OP11, "op12_conversation_prefix_trie": OP12, "op13_target_resampling": OP13}
