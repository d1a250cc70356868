"""The queries of this package that SQL can say, for DuckDB over the same tables."""

from __future__ import annotations

from maskwright.llm.common import LOWER, UPPER, WORD_PATTERN
from maskwright.llm.decontaminate import WINDOW
from maskwright.llm.licenses import templates

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}')"

LINE_DEDUP = f"""with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') as key from lines),
common as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select k.*, c.first is not null and c.first <> k.doc_id as gone from keyed k left join common c on c.key = k.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from marked group by doc_id"""

DECONTAMINATION = f"""with docs as (select doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
sizes as (select *, least({WINDOW}, len(w)) as n from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from sizes)),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from sizes))),
hits as materialized (select g.doc_id, g.i, g.n, w.item_id from grams g join windows w on w.n = g.n and w.g = g.g),
hit as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items, sha256(coalesce(f.ids, '')) as items_sha256, coalesce(f.n_items, 0) >= 2 as contaminated
from docs d left join hit h on h.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id"""


def _license_scan() -> str:
    known = templates()
    stride = max(len(t.words) for t in known)
    quoted = lambda words: "['" + "', '".join(words) + "']"
    phrases = " union all ".join(f"select {quoted(t.words)} as p, '{t.label}' as label" for t in known if t.phrase)
    others = " union all ".join(f"select {quoted(t.tokens)} as t, {t.need} as need, '{t.label}' as label" for t in known if not t.phrase)
    return f"""with docs as materialized (select doc_id, {_WORDS} as w from documents),
words as materialized (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos, w from docs),
places as (select distinct d.doc_id, d.pos as start, p.label from words d, ({phrases}) p where d.word = p.p[1] and d.w[d.pos + 1:d.pos + len(p.p)] = p.p),
blocks as (select distinct doc_id, unnest([pos // {stride}, pos // {stride} - 1]) as b, word from words),
likely as (select doc_id, b, list(word) as have from blocks where b >= 0 and word in (select unnest(t) from ({others})) group by doc_id, b),
found as (select l.doc_id, t.label, len(list_intersect(t.t, l.have)) / len(t.t) as score from likely l, ({others}) t where len(list_intersect(t.t, l.have)) >= t.need),
base as (select doc_id, count(*) as n, min(start) as lo, max(start) as hi, string_agg(distinct label, ',' order by label) as labels from places group by doc_id),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from found) group by doc_id),
best as (select doc_id, max(score) as score from found group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(b.n, 0) as n_base, cast(b.lo as bigint) as first_word, cast(b.hi as bigint) as last_word, coalesce(b.labels, '') as base_labels,
 coalesce(e.labels, '') as labels, case when b.n > 0 then 1.0 else coalesce(x.score, 0.0) end::double as score
from docs d left join base b on b.doc_id = d.doc_id left join every e on e.doc_id = d.doc_id left join best x on x.doc_id = d.doc_id"""


ORACLE_SQL = {"op2_line_dedup": LINE_DEDUP, "op7_license_scan": _license_scan(), "op8_decontamination": DECONTAMINATION}
