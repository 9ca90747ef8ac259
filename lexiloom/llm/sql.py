"""DuckDB SQL for the same rows as the queries, where SQL can say it on whole tables."""

from __future__ import annotations

from . import mixing, pii, quality_rules, sharding, url_filters

_WORD = "[^\\x20\\x09-\\x0D]+"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _personal() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: case when i % 2 = 0 then substr({digits}, length({digits}) - i, 1)::int when substr({digits}, length({digits}) - i, 1)::int > 4 then substr({digits}, length({digits}) - i, 1)::int * 2 - 9 else substr({digits}, length({digits}) - i, 1)::int * 2 end)) % 10 = 0"
    kinds = [
        ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true", "lower(v)"),
        ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(concat('0', ltrim(p, '0')) as int), 999) <= 255)) = 4", "v"),
        ("card", "[0-9]([\\x20-]?[0-9])+", f"length({digits}) between 13 and 19 and {luhn}", digits),
        ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) between 9 and 15", digits),
    ]
    hits = " union all ".join(
        f"""select * exclude (hs, gs, i), {k} as o, '{name}' as kind, {normal} as value, {test} as fine from (select rid, unnest(range(1, len(hs) + 1)) as i, hs, gs, hs[i] as v, gs[i] as before, gs[i + 1] as after,
  coalesce(list_sum(list_transform(hs[1:i - 1], lambda h: length(h))), 0)::bigint + list_sum(list_transform(gs[1:i], lambda g: length(g)))::bigint as b from (select rid, regexp_extract_all(text, '{pattern}') as hs, string_split_regex(text, '{pattern}') as gs from d))"""
        for k, (name, pattern, test, normal) in enumerate(kinds)
    )
    word = "[\\p{L}\\p{M}]{3,}"
    near = lambda piece, shift, side: f"""select rid, entity, around, term, {shift} + coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0)::bigint + coalesce(list_sum(list_transform(ws[1:i - 1], lambda w: length(w))), 0)::bigint as s, length(ws[i])::bigint as n
  from (select rid, entity, around, ws, gs, b, e, bb, aa, unnest({side}) as i, lower(ws[i]) as term from (select *, regexp_extract_all({piece}, '{word}') as ws, string_split_regex({piece}, '{word}') as gs from f))"""  # noqa: E731
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
h as ({hits}),
f as (select rid, o, kind, b, b + length(v) as e, concat(kind, ':', value) as entity, concat(right(before, 64), chr(0), left(after, 64)) as around, right(before, 512) as bb, left(after, 512) as aa from h where fine),
c as ({near("bb", "b - length(bb)", f"range(greatest(len(ws) - {pii.NEAR}, 0) + 1, len(ws) + 1)")} union all {near("aa", "e", f"range(1, least(len(ws), {pii.NEAR}) + 1)")}),
pairs as (select entity, term, count(*) as n_pair, count(distinct around) as n_contexts from c group by all),
nears as (select entity, count(*) as n_near from c group by all),
words as (select term, count(*) as n_term from (select unnest(regexp_extract_all(lower(text), '{word}')) as term from d) group by all),
total as (select sum(n_term) as total from words),
shares as (select entity, term, 1 + ln(least(1.0, n_pair / n_term)) / -ln(n_near / greatest(total, n_near + 1)) as disclosure, n_contexts from pairs join words using (term) join nears using (entity), total),
told as (select rid, s, s + n as e, max(disclosure) as disclosure from c join shares using (entity, term) where n_contexts >= {pii.LEAST_CONTEXTS} and disclosure >= {pii.GENERALISED} group by all),
spans as (select rid, o, kind, b as s, concat(kind, ':', b, ':', e) as name, false as removed from f union all select rid, 9, 'term', s, concat('term:', s, ':', e), disclosure >= {pii.REMOVED} from told),
g as (select rid, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k, *_ in kinds)}, count(*) filter (where kind = 'term') as n_term, count(*) filter (where removed) as n_removed,
  string_agg(name, ',' order by o, s) filter (where o < 9) as base, string_agg(name, ',' order by o, s) as spans from spans group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k, *_ in kinds)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_term, 0)::bigint as n_term, coalesce(n_removed, 0)::bigint as n_removed from d left join g using (rid)"""


def _quality() -> str:
    rules = list(quality_rules.RULES)
    value = {
        "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
        "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)",
    }
    number = lambda v: "'inf'::double" if v == float("inf") else f"{v!r}::double"
    steps = ", ".join(f"({g}, {', '.join(number(v[r]) for r in rules)})" for g, v in enumerate(quality_rules.STEPS))
    over = " or ".join(f"{value[r]} > c_{r}" for r in rules)
    n, p = len(quality_rules.STEPS), quality_rules.RISK
    return f"""
with t as (select doc_id, coalesce(lang, chr(0)) as stratum, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls from t),
v as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
x as (select doc_id, i, concat_ws(chr(1), ws[i], ws[i + 1], ws[i + 2]) as win from v),
r as (select doc_id, i from x qualify count(*) over (partition by doc_id, win) > 1),
c as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from r, (select unnest([0, 1, 2]) as k) group by doc_id),
m as (select w.doc_id, stratum, text, len(ws)::bigint as n_words, list_sum(list_transform(ws, lambda s: length(s)))::bigint as wc, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join c using (doc_id)),
f as (select *, coalesce(wc, 0) as word_chars, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words as base_failed from m),
steps(g, {', '.join(f'c_{r}' for r in rules)}) as (values {steps}),
s as (select f.*, coalesce((select min(g) from steps where {over}), {n}) as step from f),
known as (select doc_id, min(quality) as good from labels where quality is not null and doc_id is not null group by doc_id),
trials as (select stratum, text, min(step) as step, min(good) as good from s join known using (doc_id) where not base_failed group by stratum, text),
totals as (select stratum, count(*) filter (where good = 1) as n_good, count(*) filter (where good = 0) as n_bad from trials group by stratum),
tests as (select stratum, n_good, n_bad, g, (select count(*) from trials u where u.stratum = o.stratum and step <= g and good = 1) as k_good, (select count(*) from trials u where u.stratum = o.stratum and step <= g and good = 0) as k_bad from totals o, steps),
tails as (select *, case when k_good > n_good * {p} then 1.0 else list_sum(list_transform(range(0, k_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({p}) + (n_good - j) * ln(1 - {p})))) end as tail from tests),
worst as (select *, max(tail) over (partition by stratum order by g) as worst, k_bad / greatest(n_bad, 1) - k_good / greatest(n_good, 1) as gain from tails),
cuts as (select stratum, g as cut_step from worst where worst <= {quality_rules.ERROR} / (select count(*) from totals) and gain > 0 qualify row_number() over (partition by stratum order by gain desc, g) = 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and step > coalesce(cut_step, -1) as kept from s left join cuts using (stratum)"""


def _near() -> str:
    return f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) end as sh from w),
d as (select doc_id, len(sh)::bigint as n, md5(array_to_string(list_sort(sh), chr(10))) as k from s),
c as (select k, n, min(doc_id) as class_id from d where n > 0 group by k, n),
u as (select class_id, n, unnest(sh) as x from c join s on doc_id = class_id),
o as (select a.class_id as a, b.class_id as b, a.n as na, b.n as nb, count(*) as both_ from u a join u b on a.x = b.x and a.class_id < b.class_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
links as (select a, b from o where 100 * both_ >= 85 * (na + nb - both_)),
e as (select a, b from links union all select b, a from links),
r(node, root) as (select class_id, class_id from c union select e.b, r.root from r join e on e.a = r.node),
top as (select node, min(root) as component_id from r group by node),
deg as (select a, count(*)::bigint as n_links from e group by a)
select d.doc_id, d.n as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept, coalesce(c.class_id, d.doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links
from d left join c on d.k = c.k and d.n = c.n left join top on top.node = c.class_id left join deg on deg.a = c.class_id"""


def _leaks() -> str:
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}')"
    return f"""
with i as (select cast(coalesce(item_id::varchar, '') as varchar) as item, {words} as ws from benchmark),
iw as (select distinct item, least(len(ws), 10) as n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') as win from (select item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as k from i where len(ws) > 0)),
sizes as (select distinct n from iw),
d as (select doc_id, {words} as ws from documents),
dw as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') as win from (select doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) as k from d, sizes where len(ws) >= n)),
h as (select doc_id, n, k, item from dw join iw using (n, win)),
hits as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(k, k + n)) as p from (select distinct doc_id, n, k from h)) group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""


def _urls() -> str:
    rule = "null"
    for name, _ in sorted(url_filters.RULES, key=lambda r: len(r[0])):
        host, _, rest = name.partition("/")
        rule = f"case when (host = '{host}' or host like '%.{host}') and starts_with(path, '/{rest}') then '{name}' else {rule} end"
    given = " ".join(f"when '{name}' then '{verdict}'" for name, verdict in url_filters.RULES)
    k = url_filters
    return f"""
with b as (select page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
p as (select *, regexp_replace(regexp_replace(path, '/[0-9a-fA-F-]{{16,}}', '/<id>', 'g'), '[0-9]+', '<n>', 'g') as shape, try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?\\z', 1), '') as bigint) as label_key from b),
known as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
t as (select host, shape, count(*) as n, count(quality) as labelled, count(*) filter (where quality = 1) as good from p left join known on doc_id = label_key group by host, shape),
e as (select *, string_split(shape, '/') as ss from t),
nodes as (select host, shape, n, labelled, good, k, array_to_string(ss[1:k], '/') as key, case when k > 1 then array_to_string(ss[1:k - 1], '/') end as up, ss[k] as segment from (select *, unnest(range(1, len(ss) + 1)) as k from e)
  union all select host, shape, n, labelled, good, 0, null, null, null from e),
sums as (select host, k, key, any_value(up) as up, sum(n) as n, sum(labelled) as labelled, sum(good) as good from nodes group by host, k, key),
tested as (select c.host, c.k, c.key, c.n < {k.LEAST_PAGES} or c.labelled = 0 or abs(c.good / greatest(c.labelled, 1) - u.good / greatest(u.labelled, 1)) <= {k.Z} * sqrt(u.good / greatest(u.labelled, 1) * (1 - u.good / greatest(u.labelled, 1)) / greatest(c.labelled, 1)) as merged
  from sums c join sums u on c.host = u.host and u.k = c.k - 1 and c.up is not distinct from u.key where c.k > 0),
named as (select host, shape, string_agg(case when merged and segment <> '' then '*' else segment end, '/' order by k) as template from nodes join tested using (host, k, key) group by host, shape),
placed as (select t.*, template from t join named using (host, shape)),
every as (select case when sum(labelled) > 0 then sum(good) / sum(labelled) else 1.0 end as share from placed),
hosts as (select host, (sum(good) + {k.SMOOTH} * any_value(share)) / (sum(labelled) + {k.SMOOTH}) as hp from placed, every group by host),
pure as (select host, template, (sum(good) + {k.SMOOTH} * any_value(hp)) / (sum(labelled) + {k.SMOOTH}) as purity from placed join hosts using (host) group by host, template),
j as (select page_id, host, path, template, purity, {rule} as rule from p join placed using (host, shape) join pure using (host, template))
select page_id, host, path, rule, case rule {given} else case when purity < {k.LEAST_PURITY} then 'block' else 'allow' end end as verdict, template, purity from j"""


def _shards(shards: int = 24) -> str:
    loop = lambda n: f"""r{n}(doc_id, key, spot, ahead) as (select doc_id, key, 0::bigint, 0::double from k
  union all select doc_id, (key::uhugeint * 2862933555777941757 + 1) % 18446744073709551616, trunc(ahead)::bigint,
    (trunc(ahead)::bigint + 1)::double * (2147483648.0::double / ((((key::uhugeint * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::double) from r{n} where ahead < {n}),
f{n} as (select doc_id, max(spot) as shard from r{n} group by doc_id)"""  # noqa: E731
    return f"""
with recursive k as (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint::uhugeint as key from documents),
{loop(shards)},
{loop(shards + 1)},
poly(i, j, v) as (select i, 0, i::bigint from range(256) g(i) union all select i, j + 1, case when v & 1 = 1 then xor(3988292384::bigint, v >> 1) else v >> 1 end from poly where j < 8),
tab as (select list(v order by i) as t from poly where j = 8),
b as (select doc_id, coalesce(text, '') as text, hex(coalesce(text, '')) as h from documents),
c as (select doc_id, (strlen(text) + 8)::bigint as size, xor(4294967295::bigint, list_reduce(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::bigint)) as text_crc32 from b, tab)
select c.doc_id, size, text_crc32, 'key' as law, f{shards}.shard::int as shard, (row_number() over (partition by f{shards}.shard order by c.doc_id, text_crc32, size) - 1)::bigint as slot, f{shards + 1}.shard::int as grown_shard
from c join f{shards} using (doc_id) join f{shards + 1} using (doc_id)"""


def _preferences() -> str:
    shown = "concat('<|', role, '|>', chr(10), replace(text, '<|', '<||'), '<|end|>', chr(10))"
    return f"""
with t as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
l as (select conv_id, max(turn) filter (where role = 'assistant') as last from t group by conv_id),
r as (select conv_id, turn, role, case when role = 'assistant' and turn = last then substr(text, 1, length(text) // 2) else text end as text from t join l using (conv_id)),
f as (select conv_id, min(turn) as first from t join r using (conv_id, turn) where t.role <> r.role or t.text <> r.text group by conv_id),
c as (select conv_id, case when first is null or turn < first then 'prompt' else 'chosen' end as part, turn, role, text from t left join f using (conv_id)
  union all select conv_id, 'rejected', turn, role, text from r join f using (conv_id) where turn >= first)
select conv_id, part, turn, role, {shown} as segment, part <> 'prompt' and role = 'assistant' as loss from c"""


def _mixed() -> str:
    weights = ", ".join(f"{w}.0" for w in mixing.WEIGHTS)
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size,
  ('0x' || substr(md5(concat_ws(chr(31), '0', coalesce(doc_id::varchar, chr(30)), coalesce(text, chr(30)))), 1, 12))::bigint as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([{weights}])[(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1]::double as w, source_size * {float(mixing.MOST)}::double as cap from s),
q as (select *, cap / w as ratio, (sum(source_size) over ())::double * {mixing.SHARE}::double as total, coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double) as capped,
  sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as open_ from w),
v as (select *, (total - capped) / open_ as level from q),
lv as (select level from v where level <= ratio order by ratio, level limit 1),
g as (select source, source_size, least(cap, coalesce((select level from lv) * w, cap)) as target from v),
p as (select d.*, source_size, target, floor(target + 1e-6)::bigint as budget, coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from d join g on d.source is not distinct from g.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end::bigint as epochs from p)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken, source, epochs from e"""


ORACLE_SQL = {
    "op1_pii_disclosure": _personal(),
    "op2_quality_rules": _quality(),
    "op3_minhash_near_dedup": _near(),
    "op4_benchmark_decontamination": _leaks(),
    "op7_url_templates": _urls(),
    "op8_jump_sharding": _shards(sharding.SHARDS),
    "op9_preference_formatting": _preferences(),
    "op10_source_mixing": _mixed(),
}
