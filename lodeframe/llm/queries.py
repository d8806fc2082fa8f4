"""Registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    fill_in_middle,
    html_extraction,
    language_id,
    license_scan,
    ngram_join,
    packing,
    source_divergence,
    substring_dedup,
    token_counts,
    token_store,
    topk_search,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.run,
    "op2_substring_dedup": substring_dedup.run,
    "op3_html_extraction": html_extraction.run,
    "op4_token_store": token_store.run,
    "op5_topk_search": topk_search.run,
    "op6_toxicity": toxicity.run,
    "op7_ngram_jaccard_join": ngram_join.run,
    "op8_language_id": language_id.run,
    "op9_token_counts": token_counts.run,
    "op10_benchmark_decontamination": decontamination.run,
    "op11_license_scan": license_scan.run,
    "op12_source_divergence": source_divergence.run,
    "op13_fill_in_middle": fill_in_middle.run,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _phrases() -> str:
    """(phrase, words, label) of the license scan as rows."""
    return ", ".join(f"({_quoted(p)}, {len(p.split())}, {_quoted(label)})" for p, label in license_scan.PHRASES)


def _templates() -> str:
    """(id, label, distinct words, their number, words of a window) of the license scan as rows."""
    rows = []
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        words = [w.decode() for w in license_scan.words_of(text)]
        own = sorted(set(words))
        rows.append(f"({i}, {_quoted(label)}, [{', '.join(map(_quoted, own))}], {len(own)}, {license_scan.SLACK * len(words)})")
    return ", ".join(rows)


#: Statements for DuckDB.  The other operators are beyond SQL (models, tokenizers, HTML, packing) or too slow in it.
SQL: dict[str, str] = {
    "op5_topk_search": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op7_ngram_jaccard_join": f"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
g as (select rid, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' '))) end as g from d),
n as (select rid, len(g) as n from g), u as (select rid, unnest(g) as t from g),
p as (select a.rid as x, b.rid as y, count(*) as m from u a join u b on a.t = b.t and a.rid < b.rid group by 1, 2),
l as (select x, y from p join n a on a.rid = x join n b on b.rid = y where 100 * m >= 85 * (a.n + b.n - m)),
e as (select x, y from l union all select y, x from l),
r as (select rid as x, rid as y from d union select r.x, e.y from r join e on e.x = r.y)
select o.doc_id, n.n as n_shingles, c.component_id from d o join n using (rid) join (select r.x as rid, min(d.doc_id) as component_id from r join d on d.rid = r.y group by 1) c using (rid)""",
    "op10_benchmark_decontamination": f"""
with b as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
bp as (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as s from bp),
d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
dp as (select rid, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win) where len(w) >= k),
hits as (select rid, p, k, item_id from (select rid, p, k, array_to_string(w[p:p + k - 1], ' ') as s from dp) join win using (k, s)),
hw as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + k)) as q from hits) group by 1),
hi as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as string))), ',') as ids from hits group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (rid) left join hi using (rid)""",
    "op11_license_scan": f"""
with d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
b as (select rid, p, label from (select rid, w, unnest(range(1, len(w) + 1)) as p from d), (values {_phrases()}) l(phrase, k, label) where array_to_string(w[p:p + k - 1], ' ') = phrase),
f as (select rid, count(*) as n, min(p) - 1 as first_word, max(p) - 1 as last_word, list(distinct label) as labels from b group by 1),
t as (select id, label, unnest(words) as word, size, m from (values {_templates()}) l(id, label, words, size, m)),
a as (select rid, p, id, label, size, m, word from (select rid, unnest(w) as word, generate_subscripts(w, 1) as p from d) join t using (word)),
h as (select * from a join (select rid, id from a group by rid, id, size having count(distinct word) >= ceil(round({license_scan.THRESHOLD} * size, 9))) using (rid, id)),
k as (select x.rid, x.label, count(distinct y.word) as n, x.size from h x join h y on x.rid = y.rid and x.id = y.id and y.p between x.p and x.p + x.m - 1 group by x.rid, x.id, x.p, x.label, x.size having count(distinct y.word) >= ceil(round({license_scan.THRESHOLD} * x.size, 9))),
g as (select rid, max(n / size) as score, list(distinct label) as labels from k group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(f.n, 0) as n_base, f.first_word, f.last_word, coalesce(array_to_string(list_sort(f.labels), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(f.labels, g.labels))), ','), '') as labels, case when f.n > 0 then 1.0 else coalesce(g.score, 0) end :: double as score
from d left join f using (rid) left join g using (rid)""",
    "op12_source_divergence": """
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term from w group by 1, 2 having count(distinct rid) >= 3),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by 1, 2, 3),
g as (select lang, source, cast(coalesce(sum(n), 0) + coalesce(any_value(v), 0) as hugeint) as size from (select distinct lang, source from d) left join c using (lang, source) left join (select lang, count(*) as v from kept group by 1) using (lang) group by 1, 2),
gp as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000 :: hugeint * (coalesce(n, 0) + 1)) // size as p from g join kept using (lang) left join c using (lang, source, term)),
lp as (select lang, term, 1 + (1000000000 :: hugeint * (sum(n) + 1)) // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang)) as q from c group by 1, 2),
pairs as (select lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from gp a join gp b using (lang, term) where a.source <> b.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    union all select lang, source, 'term', term, (p - q) * (p - q) // q from gp join lp using (lang, term) where n > 0 and p > q),
o as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from r)
select * from o where part = 'pair' or rank <= 200""",
    "op13_fill_in_middle": """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as string), '')) as h from documents),
n as (select doc_id, t, length(t) as n, list_transform(range(4), lambda i: ('0x' || substr(h, i * 8 + 1, 8)) :: bigint) as h from h),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from n),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from p""",
}
