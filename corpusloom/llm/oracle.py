"""SQL for those queries over training data that DuckDB can answer on small tables.

Words and consistent forms are spelt out in SQL: characters are replaced one by
one, which gives the same equalities as the token-wise rule of the operators on
texts whose foreign words don't turn into Latin ones.
"""

from __future__ import annotations

from corpusloom.llm.textform import LOOK_ALIKE

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_FROM = _FULL + "\u3000\u00a0\u2007\u202f" + "".join(LOOK_ALIKE)
_TO = "".join(chr(ord(c) - 0xFEE0) for c in _FULL) + "    " + "".join(LOOK_ALIKE.values())
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def form(column: str) -> str:
    """Consistent form of a column."""
    x = f"regexp_replace({column}, '[\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')"
    for a, b in _LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, '{_quoted(_FROM)}', '{_quoted(_TO)}'))"


def words(column: str) -> str:
    return rf"regexp_extract_all(lower({form(column)}), '[\p{{L}}\p{{N}}]+')"


def pairs(column: str) -> str:
    """Distinct pairs of adjacent words of a list of words."""
    return f"list_distinct(list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1]))"


_VALIDATION = f"v as (select record_id as k, {pairs('w')} as p from (select record_id, {words('text')} as w from just_1_sub_validation_en where text is not null))"
_TRAIN = f"t as (select record_id as k, {pairs('w')} as p from (select record_id, {words('text')} as w from just_1_sub_train_en where text is not null))"
_ARTICLES = f"u as (select distinct doc_id as k, unnest({pairs('w')}) as x from (select doc_id, {words('sentences')} as w from (select distinct doc_id, sentences from ccf_processed_data where sentences is not null and doc_id is not null)))"


def _like(a: str, b: str, condition: str) -> str:
    """Pairs of keys with a likeness of at least 0.6 from relations (k, x) of distinct pairs."""
    return f"""select a.k as ka, b.k as kb from {a} a join {b} b on a.x = b.x join (select k, count(*) as n from {a} group by 1) na on na.k = a.k join (select k, count(*) as n from {b} group by 1) nb on nb.k = b.k
      where {condition} group by a.k, b.k, na.n, nb.n having count(*) >= 0.6 * (na.n + nb.n - count(*)) - 1e-9"""


P3 = f"with {_VALIDATION}, {_TRAIN}, vx as (select distinct k, unnest(p) as x from v), tx as (select distinct k, unnest(p) as x from t) select ka as record_id, kb as train_record_id from ({_like('vx', 'tx', 'true')})"

P3_REPORT = f"""
with e as (select record_id, split, coalesce(source, '(none)') as source, {words('text')} as w from just_1_sub_validation_en),
q as (select distinct record_id, array_to_string(w, ' ') as line, w from e where len(w) > 0), tw as (select distinct record_id, {words('text')} as w from just_1_sub_train_en where text is not null),
r as (select distinct unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as x from tw),
m as (select line, n, unnest(range(i, i + 8)) as pos from (select line, n, p.i as i, p.x as x from (select line, len(w) as n, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'x': array_to_string(w[i:i + 7], ' ')}})) as p from q)) where x in (select x from r)),
c as (select line, count(distinct pos) as covered from m group by 1),
f as ({P3}), g as (select f.record_id, count(distinct train_record_id) as training, max((tq.line = q.line)::int) as exact from f join q using (record_id) join (select record_id, array_to_string(w, ' ') as line from tw) tq on tq.record_id = f.train_record_id group by 1),
z as (select record_id, max(coalesce(covered, 0) / len(w)) as cover from q left join c using (line) group by 1),
o as (select distinct record_id, split, source from e)
select split, source, count(*) as n_records, count(training) as n_overlapping, coalesce(sum(exact), 0)::bigint as n_exact, coalesce(sum(training), 0)::bigint as n_training_pairs, round(avg(cover), 6) as mean_coverage from o left join g using (record_id) left join z using (record_id) group by 1, 2"""

P4 = (
    f"with {_VALIDATION}, {_ARTICLES}, vx as (select distinct k, unnest(p) as x from v) "
    f"select 'just_1_sub_validation_en' as tab, ka as key_a, kb as key_b from ({_like('vx', 'vx', 'a.k < b.k')}) union all select 'ccf_processed_data', ka, kb from ({_like('u', 'u', 'a.k < b.k')})"
)

P4_GROUPS = f"""
with recursive {_VALIDATION}, {_ARTICLES}, s as (select 'just_1_sub_validation_en' as tab, k, x from (select distinct k, unnest(p) as x from v) union all select 'ccf_processed_data', k, x from u),
c as (select tab, k, min(k) over (partition by tab, p) as rep from (select tab, k, list_sort(list(x)) as p from s group by 1, 2)),
e as (select s.* from s join c using (tab, k) where c.rep = s.k), n as (select tab, k, count(*) as n from e group by 1, 2),
l as (select a.tab, a.k as a, b.k as b from e a join e b on a.tab = b.tab and a.x = b.x and a.k <> b.k join n na on (na.tab, na.k) = (a.tab, a.k) join n nb on (nb.tab, nb.k) = (b.tab, b.k) group by a.tab, a.k, b.k, na.n, nb.n having count(*) >= 0.6 * (na.n + nb.n - count(*)) - 1e-9),
reach(tab, k, other) as (select distinct tab, rep, rep from c union select r.tab, r.k, l.b from reach r join l on l.tab = r.tab and l.a = r.other),
g as (select tab, k, min(other) as group_key from reach group by 1, 2)
select c.tab, c.k as key, c.rep as class_key, g.group_key, (select count(*) from l where l.tab = c.tab and l.a = c.rep) as n_links from c join g on g.tab = c.tab and g.k = c.rep"""

P5 = f"with f as (select distinct record_id as k, text, {form('text')} as f from just_1_sub_validation_en where text is not null) select distinct a.k as record_id_a, b.k as record_id_b from f a join f b on a.f = b.f and a.k < b.k and a.text <> b.text where trim(a.f, ' \t\n\r') <> ''"

P6 = f"""
with recursive r as (select record_id as k, {form('text')} as f from just_1_sub_validation_en where text is not null union select record_id, {form('text')} from just_1_sub_train_en where text is not null),
n as (select distinct k, f from r where trim(f, ' \t\n\r') <> ''),
d as (select distinct doc_id, {form('sentences')} as f from ccf_processed_data where sentences is not null and doc_id is not null),
j as (select distinct 'd' || d.doc_id as g, n.f from d join n using (f)),
e as (select n.k, 'f' || md5(n.f) as g from n union select n.k, j.g from n join j using (f)),
reach(k, other) as (select k, k from e union select reach.k, b.k from reach join e a on a.k = reach.other join e b on b.g = a.g)
select k as record_id, min(other) as group_record_id from reach group by k having count(*) >= 2"""

_WINDOWS = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"
P8 = f"""
with d as (select doc_id, unnest({_WINDOWS}) as x from (select doc_id, {words('text')} as w from documents where text is not null)),
i as (select item_id, unnest({_WINDOWS}) as x from (select item_id, {words('text')} as w from gold_test_items where text is not null))
select distinct doc_id, item_id from d join i using (x)"""

_COS = "round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 9)"
P1 = f"""
with x as (select doc_id, sentence_id::bigint as sentence_id, any_value(embedding::double[]) as e from ccf_sentence_embeddings where len(embedding) = 96 and doc_id is not null and sentence_id is not null and list_inner_product(embedding::double[], embedding::double[]) > 0 group by 1, 2),
s as (select a.doc_id as d, a.sentence_id as s, b.doc_id as d2, b.sentence_id as s2, {_COS} as cos from x a join x b on (a.doc_id, a.sentence_id) <> (b.doc_id, b.sentence_id)),
n as (select * from s where cos >= 0.96 qualify row_number() over (partition by d, s order by cos desc, d2, s2) <= 10)
select distinct case when (d, s) < (d2, s2) then d else d2 end as doc_id_a, case when (d, s) < (d2, s2) then s else s2 end as sentence_id_a,
  case when (d, s) < (d2, s2) then d2 else d end as doc_id_b, case when (d, s) < (d2, s2) then s2 else s end as sentence_id_b from n"""

# smallest keys spread along the links; each round reaches one link farther, and eight are more than these groups need
_ROUNDS = ", ".join(f"l{k + 1} as (select d, s, min(c) as c from (select d, s, c from l{k} union all select g.d, g.s, l.c from g join l{k} l on (g.d2, g.s2) = (l.d, l.s)) group by 1, 2)" for k in range(8))
P2 = f"""
with x as (select doc_id, sentence_id::bigint as sentence_id, any_value(embedding::double[]) as e from ccf_sentence_embeddings where len(embedding) = 96 and doc_id is not null and sentence_id is not null and list_inner_product(embedding::double[], embedding::double[]) > 0 group by 1, 2),
g as materialized (select a.doc_id as d, a.sentence_id as s, b.doc_id as d2, b.sentence_id as s2 from x a join x b on (a.doc_id, a.sentence_id) <> (b.doc_id, b.sentence_id) where {_COS} >= 0.6),
l0 as (select doc_id as d, sentence_id as s, {{'a': doc_id, 'b': sentence_id}} as c from x), {_ROUNDS}
select d as doc_id, s as sentence_id, c.a as cluster_doc_id, c.b as cluster_sentence_id from l8 qualify count(*) over (partition by c) >= 10"""

P7 = "select count(distinct doc_id) as n_documents, true as whole, true as within from documents where length(text) > 0"

SQL = {"p7_checks": P7, "p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_report": P3_REPORT, "p4_found": P4, "p4_groups": P4_GROUPS, "p5_found": P5, "p6_found": P6, "p6_incremental": P6, "p8_found": P8}
