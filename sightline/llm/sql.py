"""DuckDB SQL of the results that SQL can express, over the same tables."""

from __future__ import annotations

from sightline.llm.decontaminate import N
from sightline.llm.mixing import BLOCKS, LEAST_BLOCKS, MOST, SEED
from sightline.llm.ngram_join import PER_CENT
from sightline.llm.ngram_join import WORDS as SHINGLE
from sightline.llm.quality_rules import RULES
from sightline.llm.stats import STOP_FORMS
from sightline.llm.warc import REVISIT_FROM

ORACLES: dict[str, str] = {}

# Words by the pattern for one run of characters that are not separators.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule(r) -> str:
    ratio = f"(cast({r.over} as double) / greatest({r.under}, 1))"
    parts = [f"{ratio} >= {r.low}" if r.low is not None else "", f"{ratio} <= {r.high}" if r.high is not None else ""]
    inside = " and ".join(p for p in parts if p)
    return f"(n_words < {r.from_words} or ({inside}))" if r.from_words else f"({inside})"


ORACLES["op4_quality_rules"] = rf"""
with base as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
win as (
  select k, i, array_to_string(w[i:i + 4], ' ') as g
  from base, unnest(range(1, greatest(len(w) - 3, 1))) as u(i) where len(w) >= 5),
twice as (select k, i from win qualify count(*) over (partition by k, g) > 1),
inside as (select distinct k, i + j as p from twice, unnest(range(0, 5)) as u(j)),
rep as (select k, count(*) as n from inside group by 1),
lines as (
  select k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from base),
counts as (
  select base.k, doc_id, length(text) as n_chars, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: x in ({", ".join(f"'{w}'" for w in STOP_FORMS)}))) as n_stop
  from base join lines using (k) left join rep using (k)),
based as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and {" and ".join(_rule(r) for r in RULES)} as kept
from based
"""


# The awards are ranked one by one here, as the method is told.
ORACLES["op5_mixing"] = rf"""
with docs as (
  select doc_id, source, len({WORDS}) as size, coalesce(text, '') as text,
    cast('0x' || substr(md5('{SEED}/' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    row_number() over (order by source asc nulls last) as place from docs group by 1),
weighed as (
  select *, (place - 1) % 3 + 1 as weight, {MOST} * source_size as cap,
    cast(sum(source_size) over () as bigint) as total from sources),
levels as (
  select *, cast(total - (sum(cap) over l - cap) as double)
    / (sum(weight) over () - sum(weight) over l + weight) as level
  from weighed window l as (order by cast(cap as double) / weight, place)),
aimed as (select *, least(cast(cap as double), weight * max(level) over ()) as target from levels),
plan as (
  select *, greatest(1, least(total // {BLOCKS}, cast(floor(
    min(case when target > 0 then target end) over () / {LEAST_BLOCKS}) as bigint))) as block from aimed),
seats as (
  select source, row_number() over (order by target / (2 * seat + 1) desc, place) as turn,
    total // block as blocks
  from plan, unnest(range(0, cast(ceil(target / block) as bigint) + (select count(*) from plan) + 2)) as u(seat)
  where target > 0),
won as (select source, count(*) as won from seats where turn <= blocks group by 1),
placed as (
  select docs.*, source_size, target,
    least(coalesce(won.won, 0) * block, {MOST} * source_size) as mass,
    coalesce(sum(size) over (partition by docs.source order by h, size
      rows between unbounded preceding and 1 preceding), 0) as start
  from docs join plan on docs.source is not distinct from plan.source
  left join won on docs.source is not distinct from won.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast({" + ".join(f"greatest(0, least(mass, start + {i} * source_size + size) - (start + {i} * source_size))" for i in range(3))} as bigint) as taken
from placed
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontamination"] = rf"""
with items as (
  select cast(item_id as varchar) as item_id, {LETTERS} as w from benchmark),
item_windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select *, least({N}, len(w)) as size from items where len(w) > 0),
    unnest(range(1, len(w) - size + 2)) as u(i)),
docs as (select row_number() over () as k, doc_id, {LETTERS} as w from documents),
doc_windows as (
  select k, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from docs, (select distinct size from item_windows),
    unnest(range(1, greatest(len(w) - size + 2, 1))) as u(i)),
hits as (select k, i, size, item_id from doc_windows join item_windows using (size, g)),
words as (
  select k, count(distinct i + j) as n from (select distinct k, i, size from hits),
    unnest(range(0, size)) as u(j) group by 1),
named as (select k, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as ids
  from hits group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit,
  cast(coalesce(named.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(words.n, 0) > 0 as contaminated
from docs left join words using (k) left join named using (k)
"""

LOWERED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

ORACLES["op2_ngram_join"] = rf"""
with recursive docs as (select row_number() over () as r, doc_id, {LOWERED} as w from documents),
tokens as (
  select distinct r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as g
  from docs, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as u(i) where len(w) > 0),
sizes as (select r, count(*) as n from tokens group by 1),
shared as (
  select a.r as a, b.r as b, count(*) as n from tokens a join tokens b using (g) where a.r <> b.r group by 1, 2),
links as (
  select shared.a, shared.b from shared join sizes x on x.r = a join sizes y on y.r = b
  where 100 * shared.n >= {PER_CENT} * (x.n + y.n - shared.n)),
reach as (
  select r as a, r as b from docs union select reach.a, links.b from reach join links on links.a = reach.b)
select docs.doc_id, cast(coalesce(any_value(sizes.n), 0) as bigint) as n_shingles, min(other.doc_id) as component_id
from docs left join sizes using (r) join reach on reach.a = docs.r join docs other on other.r = reach.b
group by docs.r, docs.doc_id
"""

ORACLES["op3_warc"] = f"""
with told as (select page_id, coalesce(html, '') as html from pages),
sized as (
  select page_id, html, cast(octet_length(encode(html)) as bigint) as size,
    max(page_id) over (partition by html) as first from told)
select page_id, size as payload_bytes, sha1(html) as payload_digest,
  if(size >= {REVISIT_FROM} and first is distinct from page_id, 'revisit', 'response') as record_type,
  if(size >= {REVISIT_FROM} and first is distinct from page_id, first, null) as refers_to
from sized
"""
