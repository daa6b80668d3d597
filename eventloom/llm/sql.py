"""The same results in DuckDB's SQL, where it can express them."""

from __future__ import annotations

from eventloom.llm import license_scan
from eventloom.llm.decontamination import SLOP, WINDOW

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = f"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format('text')} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_WORDS.format('text')} as w from benchmark),
win as (
  select distinct item_id, w[s:s + {WINDOW - 1}] as words
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) as s from b where len(w) > 0)
),
tok as (select r, unnest(w) as t, generate_subscripts(w, 1) - 1 as p from d),
cf as (select t, count(*) as n from tok group by t),
place as (
  select words, len(words) as len, t, o,
    row_number() over (partition by words order by coalesce(n, 0), o) - 1 as nth
  from (select words, unnest(words) as t, generate_subscripts(words, 1) - 1 as o from (select distinct words from win)) x
  left join cf using (t)
),
shifted as (select words, len, nth, r, p - o as s from place join tok using (t) where nth < 2),
cand as (
  select words, r, s, min(k) as ok, min(e) as exact from (
    select a.words, a.r, a.s, n.nth,
      coalesce(bool_or(a.len <= n.nth or abs(x.s - a.s) <= {SLOP}), false) as k, coalesce(bool_or(a.len <= n.nth or x.s = a.s), false) as e
    from shifted a cross join (values (1)) n(nth)
    left join shifted x on x.words = a.words and x.r = a.r and x.nth = n.nth and x.s between a.s - {SLOP} and a.s + {SLOP}
    where a.nth = 0 group by a.words, a.r, a.s, n.nth
  ) group by words, r, s having min(k)
),
found as (
  select c.*, coalesce(c.exact and c.s >= 0 and d.w[c.s + 1:c.s + len(c.words)] = c.words, false) as same from cand c join d using (r)
),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(s, s + len(words) - 1)) as p from found where same) group by r),
near as (select words, r, same from found),
items as (
  select r, list_sort(list(item_id) filter (where e)) as items, count(*) filter (where not e) as n_near
  from (select r, item_id, bool_or(same) as e from near join win using (words) group by r, item_id) group by r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join hit using (r) left join items using (r)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({i}, {_quoted(label)}, {_quoted(text)}, {exact})"
    for i, (label, text, exact) in enumerate(
        [(v, k, "true") for k, v in license_scan.PHRASES.items()] + [(k, v, "false") for k, v in license_scan.TEMPLATES.items()]
    )
)
_G = license_scan.GRAM
OP5 = f"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format('text')} as w from documents),
tpl as (select t, label, exact, {_WORDS.format('text')} as tw from (values {_TEMPLATES}) v(t, label, text, exact)),
place as (
  select t, label, exact, len(tw) - {_G - 1} as grams, k - 1 as o, tw[k:k + {_G - 1}] as gram
  from (select *, unnest(generate_series(1, len(tw) - {_G - 1})) as k from tpl)
),
first as (select distinct gram[1] as f from place),
roll as (
  select r, p - 1 as p, w[p:p + {_G - 1}] as gram from (select r, w, unnest(w) as f, generate_subscripts(w, 1) as p from d)
  join first using (f) where p <= len(w) - {_G - 1}
),
votes as (select distinct r, t, label, exact, grams, o, p from roll join place using (gram)),
diag as (
  select r, t, label, exact, grams, p - o as g, count(*) as n, min(p) as lo, max(p) as hi, list(o) as ats from votes group by all
),
base as (select r, label, exact, g as s, 1.0 as share from diag where exact and n = grams),
split as (select *, case when g - lag(g) over (partition by r, t order by g) <= {license_scan.GAP} then 0 else 1 end as cut from diag where not exact),
runs as (select *, sum(cut) over (partition by r, t order by g) as run from split),
merged as (
  select r, label, exact, grams, min(lo) as s, max(hi) + {_G} as e, len(list_distinct(flatten(list(ats)))) / grams as share,
    list({{'s': lo, 'share': n / grams}}) filter (where n / grams >= {license_scan.COVERED}) as singles
  from runs group by r, t, label, exact, grams, run
),
spans as (
  select r, label, exact, s, share from merged where e - s <= 2 * (grams + {_G}) and share >= {license_scan.COVERED} union all
  select r, label, exact, one.s, one.share from (select r, label, exact, unnest(singles) as one from merged where e - s > 2 * (grams + {_G}))
),
alls as (select r, label, exact, s, share from base union all select r, label, exact, s, share from spans),
found as (
  select r, count(*) filter (where exact) as n_base, min(s) filter (where exact) as first_word, max(s) filter (where exact) as last_word,
    array_to_string(list_sort(list(distinct label) filter (where exact)), ',') as base_labels,
    array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score, count(*) as n_spans
  from alls group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
  cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  cast(coalesce(score, 0) as double) as score, coalesce(n_spans, 0) as n_spans
from d left join found using (r)
"""

ORACLES = {"op5_license_scan": OP5, "op10_positional_decontamination": OP10}
