"""DuckDB SQL for the queries that SQL can express.

Left out, and tested against brute force, exact round trips or held-out accuracy instead: op2 (a trained model), op3 (stored bytes), op4 and op7
(they follow 64-bit hashes that DuckDB does not have), op9 (a Bloom filter), op10 (a tokenizer) and the pipeline.
"""

from __future__ import annotations

from loomtally.llm import quality_rules
from loomtally.llm.chat import END, TEXT, TURN
from loomtally.llm.queries import URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = f"""
with recursive words as (
  select row_number() over () as r, doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
sets as (
  select r, doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
keyed as (select r, doc_id, s, md5(array_to_string(s, chr(10))) as g from sets),
groups as (select g, any_value(s) as s, len(any_value(s)) as n, min(doc_id) as least, count(*) as copies from keyed where len(s) > 0 group by g),
entries as (select g, n, unnest(s) as x from groups),
shared as (select * from entries where x in (select x from entries group by x having count(*) > 1)),
links as (
  select a.g as a, b.g as b from shared a join shared b on a.x = b.x and a.g <> b.g group by a.g, b.g, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select g, g as h from groups union select reach.g, links.b from reach join links on links.a = reach.h),
top as (select reach.g, min(o.least) as component_id from reach join groups o on o.g = reach.h group by reach.g)
select k.doc_id, cast(len(k.s) as bigint) as n_shingles, case when len(k.s) = 0 then k.doc_id else coalesce(top.component_id, k.doc_id) end as component_id,
  case when len(k.s) = 0 then 1 else groups.copies end as copies
from keyed k left join top on top.g = k.g left join groups on groups.g = k.g"""

_ESC = "regexp_replace({t}, '([<\\[\\\\])', '\\1\\\\', 'g')"
OP5 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(TURN) + len(TEXT) + len(END)} + length({_ESC.format(t="role")}) + length({_ESC.format(t="text")})) as bigint) as formatted_chars
from rows group by conv_id"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6 = f"""
with urls as (
  select row_number() over () as r, page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
hits as (
  select u.r, arg_max(struct_pack(rule := x.host || x.path, verdict := x.verdict), (length(x.host) + length(x.path), length(x.host))) as best
  from urls u join (values {_RULES}) x(host, path, verdict) on (u.host = x.host or u.host like '%.' || x.host) and starts_with(u.path, x.path) group by u.r)
select page_id, host, path, hits.best.rule as rule, coalesce(hits.best.verdict, 'allow') as verdict from urls left join hits using (r)"""

_BITS = " + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, rule in enumerate(quality_rules.RULES.values()))
OP8 = f"""
with rows as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (select r, {_WORDS.format(t="t")} as w from rows),
windows as (select r, unnest(range(1, len(w) - 1)) as i, w from words),
spelled as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from windows),
repeated as (select r, i from spelled qualify count(*) over (partition by r, x) > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from repeated) group by r),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from rows),
measured as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, cast(len(l) as bigint) as n_lines, cast(length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) as bigint) as n_upper,
    cast(len(regexp_extract_all(t, '!![\\x20\\x09-\\x0D]')) as bigint) as n_shouts
  from rows join words using (r) join lines using (r) left join covered using (r))
select *, {_BITS} = 0 as kept, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, cast({_BITS} as bigint) as fail_bits from measured"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op5_chat_format": OP5, "op6_url_filter": OP6, "op8_quality_rules": OP8}
