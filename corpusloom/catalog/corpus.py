"""Scans, predicates, projections and text functions."""

from __future__ import annotations

from corpusloom.catalog.base import ARTICLES, UNITS, F, articles, query, table, units
from corpusloom.functions import text as T
from corpusloom.operators import annotate, provenance, rollup, rows
from corpusloom.plans.taxonomy import CODES, PARENT

_SPLIT = r"string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_LEX = annotate.LEXICON


def _lexicon_sql(unit: str) -> str:
    out = []
    for label, pattern in _LEX.items():
        hit = f"regexp_matches({unit}, '{pattern}')::int"
        out.append(f"case when regexp_matches({unit}, '{_LEX[PARENT[label]]}') then {hit} end as {label}" if label in PARENT else f"{hit} as {label}")
    return ", ".join(out)


@query(f"""
with s as (select doc_id, coalesce(source, '(none)') as source, {_SPLIT} as p from documents where doc_id is not null),
u as (select doc_id, source, unnest(list_transform(range(1, len(p) + 1), lambda i: case when i = 1 then p[1] else p[i - 1] || ' ' || p[i] end)) as unit from s),
l as (select doc_id, source, {_lexicon_sql('unit')} from u),
a as (select doc_id, source, count(*) n, {', '.join(f'sum(coalesce({c}, 0)) / count(*) as p_{c}' for c in _LEX)} from l group by all),
t as (select *, greatest(p_economic_frame, p_political_frame, p_environmental_frame) as best from a),
k as (select *, case when best <= 0 then null when p_economic_frame = best then 'economic_frame' when p_political_frame = best then 'political_frame' else 'environmental_frame' end as top_frame from t)
select source, coalesce(top_frame, '(none)') as top_frame, count(*) as n_articles, round(avg(best), 6) as mean_share from k group by 1, 2""")
def flagship_outlet_frames(spark, d):
    """Documents to sentences, units, gated labels, article shares, and the main frame by outlet."""
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), T.sentences("text").alias("p"))
    unit = docs.select("doc_id", "source", F.explode(T.two_sentence_units("p")).alias("unit"))
    labelled = annotate.by_lexicon(unit, "unit", _LEX)
    shares = labelled.groupBy("doc_id", "source").agg(*[(F.sum(F.coalesce(c, F.lit(0))) / F.count("*")).alias(f"p_{c}") for c in _LEX])
    best = F.greatest(*[f"p_{c}" for c in ("economic_frame", "political_frame", "environmental_frame")])
    top = F.when(best <= 0, F.lit("(none)")).when(F.col("p_economic_frame") == best, F.lit("economic_frame")).when(F.col("p_political_frame") == best, F.lit("political_frame")).otherwise(F.lit("environmental_frame"))
    return shares.select("source", top.alias("top_frame"), best.alias("best")).groupBy("source", "top_frame").agg(F.count("*").alias("n_articles"), F.round(F.avg("best"), 6).alias("mean_share"))


@query(f"""
with s as (select doc_id, {_SPLIT} as p from documents where doc_id is not null)
select doc_id, unnest(range(1, len(p) + 1)) as sentence_id,
  md5(unnest(list_transform(range(1, len(p) + 1), lambda i: case when i = 1 then p[1] else p[i - 1] || ' ' || p[i] end))) as unit_md5 from s""")
def sentence_units(spark, d):
    """Two-sentence sliding units of every document (W01, F01); no shuffle."""
    docs = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", T.sentences("text").alias("p"))
    return docs.select("doc_id", F.posexplode(T.two_sentence_units("p")).alias("i", "unit")).select("doc_id", (F.col("i") + 1).cast("long").alias("sentence_id"), F.md5("unit").alias("unit_md5"))


@query(f"with {UNITS} select doc_id, sentence_id, loaded_at from units")
def latest_units(spark, d):
    """Last delivery of every unit."""
    return units(spark, d).select("doc_id", "sentence_id", "loaded_at")


@query("select doc_id, sentence_id, language from ccf_processed_data where sentences is not null and economic_frame is null")
def unlabelled_scan(spark, d):
    """Incremental scan: text is there, target label isn't (S09); the predicate reaches the files."""
    return table(spark, d, "ccf_processed_data").filter("sentences is not null and economic_frame is null").select("doc_id", "sentence_id", "language")


@query("select doc_id, sentence_id from ccf_processed_data where sentences is not null and economic_frame = 1 and eco_cost is null and language = 'FR'")
def unlabelled_children_scan(spark, d):
    """Incremental scan of a child label: only under a positive parent, one language."""
    return table(spark, d, "ccf_processed_data").filter("sentences is not null and economic_frame = 1 and eco_cost is null and language = 'FR'").select("doc_id", "sentence_id")


@query("select count(*) as n, count(title) as n_title from ccf_full_data")
def pruned_scan(spark, d):
    """Column pruning (S02, S12): one of ten columns is read."""
    return table(spark, d, "ccf_full_data").select("title").agg(F.count("*").alias("n"), F.count("title").alias("n_title"))


@query(f"with {ARTICLES} select row_number() over (order by doc_id) as new_id, doc_id as old_id from articles")
def dense_article_ids(spark, d):
    """Old id dropped, dense ids from 1 by a given order (P01, P02), without a single-task window."""
    return rows.dense_ids(articles(spark, d).select(F.col("doc_id").alias("old_id")), ["old_id"], "new_id").select(F.col("new_id").cast("long"), "old_id")


@query(f"with {ARTICLES} select doc_id, coalesce(media, 'not provided') as media, coalesce(author, 'not provided') as author, coalesce(nullif(page_number, ''), 'not provided') as page_number, coalesce(cast(words_count as varchar), '0') as words_count from articles")
def null_defaults(spark, d):
    """Defaults in place of NULL and empty fields."""
    default = F.lit("not provided")
    return articles(spark, d, "media", "author", "page_number", "words_count").select(
        "doc_id", F.coalesce("media", default).alias("media"), F.coalesce("author", default).alias("author"), F.coalesce(F.when(F.col("page_number") != "", F.col("page_number")), default).alias("page_number"),
        F.coalesce(F.col("words_count").cast("string"), F.lit("0")).alias("words_count"),
    )


@query("select case when lower(substr(lang, 1, 2)) = 'en' then 'EN' when lower(substr(lang, 1, 2)) = 'fr' then 'FR' else coalesce(lang, '(none)') end as language, count(*) as n from documents group by 1")
def value_replacement(spark, d):
    """Spellings of a language brought to one code (P04), then counted."""
    two = F.lower(F.substring("lang", 1, 2))
    code = F.when(two == "en", "EN").when(two == "fr", "FR").otherwise(F.coalesce("lang", F.lit("(none)")))
    return table(spark, d, "documents").groupBy(code.alias("language")).agg(F.count("*").alias("n"))


@query("select coalesce(lang, '(none)') as lang, count(*) as n from documents where lang is null or lang not in ('EN', 'FR', 'en', 'fr') group by 1")
def domain_check(spark, d):
    """Values outside the domain, with counts: a warning, not a filter."""
    odd = F.col("lang").isNull() | ~F.col("lang").isin("EN", "FR", "en", "fr")
    return table(spark, d, "documents").filter(odd).groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count("*").alias("n"))


@query("select doc_id, sentence_id from ccf_processed_data where sentences is not null and trim(sentences) <> '' group by all")
def nonblank_units(spark, d):
    """Units with text (P08), distinct."""
    return table(spark, d, "ccf_processed_data").filter(rows.not_blank("sentences")).select("doc_id", "sentence_id").distinct()


@query(f"with {ARTICLES} select doc_id, try_cast(page_number as integer) as page, coalesce(try_cast(page_number as integer), 0) as page_or_zero from articles")
def numeric_coercion(spark, d):
    """Text to number, bad text to NULL or to 0."""
    return articles(spark, d, "page_number").select("doc_id", F.expr("try_cast(page_number as int)").alias("page"), rows.as_count("page_number").alias("page_or_zero"))


@query(" union all ".join(f"select '{c}' as code, sum({c})::bigint as total from ccf_processed_data having sum({c}) > 0" for c in CODES))
def detected_label_columns(spark, d):
    """Label columns by deny-list, numeric type and positive sum (P11): one aggregate for all columns."""
    return rows.detected_labels(table(spark, d, "ccf_processed_data"), {"doc_id", "sentence_id", "words_count"})


@query("select media, region from media_province where media not like '%Total%' and region is not null")
def section_filter(spark, d):
    """Total rows left out."""
    return table(spark, d, "media_province").filter(~F.col("media").contains("Total") & F.col("region").isNotNull())


@query(f"with {ARTICLES} select year(date)::int as year, count(*) as n from articles where year(date) between 2000 and (select max(year(date)) from articles where year(date) <= 2025) group by 1")
def year_range(spark, d):
    """Years from 2000 to the last one present up to 2025 (P13); the bound is a scalar subquery."""
    a = articles(spark, d, "date").select(F.year("date").alias("year")).filter("year is not null")
    top = a.filter("year <= 2025").agg(F.max("year").alias("top"))
    return a.join(F.broadcast(top), (a.year >= 2000) & (a.year <= top.top)).groupBy("year").agg(F.count("*").alias("n"))


_NER = """
m as (select doc_id, sentence_id, case when json_valid(ner_entities) and json_type(ner_entities::json) = 'OBJECT' then ner_entities::json end as j from units),
e as (select doc_id, sentence_id, k as kind, unnest(from_json(coalesce(json_extract(j, '$.' || k), '[]'), '["VARCHAR"]')) as name from m, (values ('PER'), ('ORG'), ('LOC')) v(k) where j is not null)"""


@query(f"with {UNITS}, {_NER} select kind, count(*) as n, count(distinct name) as n_distinct from e where length(name) >= 2 and not regexp_matches(name, '^[[:punct:]\\s]+$') group by 1")
def entity_filter(spark, d):
    """Entities exploded from JSON, pure punctuation and single characters left out."""
    each = rollup.exploded(units(spark, d, "ner_entities"), [])
    return each.filter(T.entity("name")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_distinct"))


@query("select number, code as label, category as name, coalesce(tier_overall, '-') as tier, round(f1_macro_all, 3) as f1 from ccf_reliability_tiers")
def canonical_projection(spark, d):
    """Columns in canonical order under canonical names."""
    return table(spark, d, "ccf_reliability_tiers").withColumnsRenamed({"code": "label", "category": "name"}).select("number", "label", "name", F.coalesce("tier_overall", F.lit("-")).alias("tier"), F.round("f1_macro_all", 3).alias("f1"))


@query("select record_id, text, cast([] as varchar[]) as label from just_1_sub_validation_en where split = 'blind'")
def blinded_records(spark, d):
    """Labels wiped for blind coding."""
    return table(spark, d, "just_1_sub_validation_en").filter("split = 'blind'").transform(lambda t: annotate.blinded(t.select("record_id", "text", F.array(F.col("label").cast("string")).alias("label"))))


_DATE = "coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%Y/%m/%d'), try_strptime(date, '%m-%d-%Y'))::date"


@query(f"select date as raw, {_DATE} as day, count(*) as n from ccf_processed_data where date is not null group by 1, 2")
def parsed_dates(spark, d):
    """Dates in several shapes; invalid ones give NULL."""
    return table(spark, d, "ccf_processed_data").filter("date is not null").groupBy(F.col("date").alias("raw")).agg(F.count("*").alias("n")).select("raw", T.parsed_date("raw").alias("day"), "n")


_YEAR = r"case when regexp_matches(date, '^\d{4}([-/]|$)') then substr(date, 1, 4)::int when regexp_matches(date, '^\d{2}-\d{2}-\d{4}$') then substr(date, 7, 4)::int end"


@query(f"""
with y as (select case when y between 1900 and 2100 then y end as y from (select {_YEAR} as y from ccf_processed_data))
select coalesce(cast(y // 10 * 10 as varchar) || 's', 'Unknown') as decade, coalesce(cast(y // 5 * 5 as varchar) || '-' || cast(y // 5 * 5 + 4 as varchar), 'Unknown') as five_years, count(*) as n from y group by 1, 2""")
def period_counts(spark, d):
    """Years from any shape, then decades and five-year periods."""
    y = table(spark, d, "ccf_processed_data").select(T.year_of("date").alias("y"))
    return y.groupBy(T.period("y", "decade").alias("decade"), T.period("y", "five_years").alias("five_years")).agg(F.count("*").alias("n"))


@query("select doc_id, lower(trim(media)) as media_key, concat_ws(' - ', trim(media), author) as line from ccf_full_data group by all")
def trimmed_names(spark, d):
    """Trim, lower case, joining with a separator."""
    return table(spark, d, "ccf_full_data").select("doc_id", F.lower(F.trim("media")).alias("media_key"), F.concat_ws(" - ", F.trim("media"), "author").alias("line")).distinct()


@query(r"""
with n as (select code || s as name from ccf_reliability_tiers, (values ('_EN.jsonl.model'), ('_FR.model'), ('_Detection_EN.jsonl.model')) v(s)),
p as (select name, regexp_replace(name, '(\.jsonl)?\.model$', '') as base from n),
q as (select name, base, case when base like '%\_EN' escape '\' then 'EN' when base like '%\_FR' escape '\' then 'FR' end as language, regexp_replace(base, '_(EN|FR)$', '') as stem from p)
select name, language, stem, case when ends_with(stem, '_Detection') then 'detection' else 'sub' end as kind, regexp_replace(stem, '_Detection$', '') as label from q""")
def model_names(spark, d):
    """Suffixes of model file names: language, kind and label."""
    t = table(spark, d, "ccf_reliability_tiers").select(F.explode(F.array(*[F.concat("code", F.lit(s)) for s in ("_EN.jsonl.model", "_FR.model", "_Detection_EN.jsonl.model")])).alias("name"))
    return provenance.model_name_parts(t, "name")


@query("select doc_id, md5(translate(nfc_normalize(text), '‘’“”ʼ', '''''\"\"''')) as folded_md5 from documents where text is not null")
def folded_quotes(spark, d):
    """Accents composed with their letter, apostrophes and quotation marks folded."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(T.folded("text")).alias("folded_md5"))


@query(r"""select doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?:[^\p{L}\p{N}_]{1,5}[A-Z][a-z]+)*'))) as spans from documents where text is not null""")
def merged_spans(spark, d):
    """Capitalised words as spans, those less than six signs apart merged."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", T.spans_of("text", "[A-Z][a-z]+").alias("offsets"))
    return t.select("doc_id", F.array_sort(F.array_distinct(T.merged_spans("text", "offsets"))).alias("spans"))


@query(r"select code, regexp_replace(code || s, '_?\d*_SUB$', '') || '_Detection' as parent from ccf_reliability_tiers, (values ('_1_SUB'), ('_12_SUB'), ('_SUB'), ('')) v(s)")
def parent_names(spark, d):
    """Name of the model that decides on a label's parent."""
    t = table(spark, d, "ccf_reliability_tiers").select("code", F.explode(F.array(*[F.concat("code", F.lit(s)) for s in ("_1_SUB", "_12_SUB", "_SUB", "")])).alias("name"))
    return t.select("code", provenance.parent_name("name").alias("parent"))


@query("select doc_id, case when n_chars is null then '--' else format('{:,}', n_chars) end as n_chars, printf('%.1f%%', round(100.0 * n_chars / (select max(n_chars) from documents), 6)) as share, coalesce(title, '--') as title from documents")
def formatted_report(spark, d):
    """Thousands, per cent and -- for NULL, as reports show them."""
    t = table(spark, d, "documents")
    top = t.agg(F.max("n_chars").alias("top"))  # one row
    return t.join(F.broadcast(top)).select("doc_id", T.thousands("n_chars").alias("n_chars"), T.percent(F.round(F.col("n_chars") / F.col("top"), 8)).alias("share"), T.dashed("title").alias("title"))


@query(f"with {UNITS} select doc_id, sentence_id from units where economic_frame is null and sentences is not null order by doc_id, sentence_id limit 100")
def unlabelled_head(spark, d):
    """The first hundred units without a label (S09, O03): the limit is the feature."""
    return annotate.unlabelled(units(spark, d, "economic_frame", "sentences"), "economic_frame", "sentences", limit=100, order=["doc_id", "sentence_id"]).select("doc_id", "sentence_id")


@query(r"select doc_id, case when trim(coalesce(text, '')) = '' then 0 else len(regexp_split_to_array(trim(text), '\s+')) end::int as n_words, case when trim(coalesce(text, '')) = '' then 0 else len(regexp_split_to_array(trim(text), '\s+')) end > 512 as too_long from documents")
def long_texts(spark, d):
    """Texts beyond 512 words are flagged, not dropped."""
    return table(spark, d, "documents").select("doc_id", T.words("text").cast("int").alias("n_words"), (T.words("text") > 512).alias("too_long"))


@query(r"select doc_id from documents where trim(coalesce(text, '')) <> '' and len(regexp_split_to_array(trim(text), '\s+')) >= 100")
def long_enough(spark, d):
    """Articles of at least 100 words."""
    return table(spark, d, "documents").filter(T.words("text") >= 100).select("doc_id")


@query("select min(doc_id) as doc_id, count(*) as copies from documents where text is not null and trim(text) <> '' group by md5(text)")
def exact_copies(spark, d):
    """One row per distinct text, with the number of copies (D01): grouped by digest with partial counts."""
    return table(spark, d, "documents").filter(rows.not_blank("text")).groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_SHINGLES = r"list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"


@query(rf"""
with m as (select min(doc_id) as doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') as w from documents where trim(coalesce(text, '')) <> '' group by md5(lower(text)), lower(text)),
s as (select doc_id, unnest({_SHINGLES}) as x from m), n as (select doc_id, count(*) as n from s group by 1)
select a.doc_id as doc_id_a, b.doc_id as doc_id_b, round(count(*) / (na.n + nb.n - count(*)), 6) as similarity from s a join s b on a.x = b.x and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
group by a.doc_id, b.doc_id, na.n, nb.n having count(*) >= 0.95 * (na.n + nb.n - count(*))""")
def near_articles(spark, d):
    """Different texts that share 95 % of their five-word shingles."""
    return rows.near_texts(table(spark, d, "documents"), "doc_id", "text", 0.95, 5)


@query(f"with {UNITS}, {_NER} select doc_id, sentence_id, count(*) as n from e group by 1, 2")
def json_round_trip(spark, d):
    """Entity JSON decoded, encoded and decoded again (F19); counts per unit."""
    once = units(spark, d, "ner_entities").select("doc_id", "sentence_id", F.to_json(F.from_json("ner_entities", rollup.ENTITIES)).alias("j"))
    e = once.select("doc_id", "sentence_id", F.from_json("j", rollup.ENTITIES).alias("e"))
    size = lambda k: F.coalesce(F.size(f"e.{k}"), F.lit(0))
    n = sum([F.when(size(k) > 0, size(k)).otherwise(0) for k in ("PER", "ORG", "LOC")], F.lit(0))
    return e.select("doc_id", "sentence_id", n.cast("long").alias("n")).filter("n > 0")


_GATES = [(c, p) for c, p in PARENT.items()]


@query(" union all ".join(f"select '{c}' as code, count(*) filter (where {c} is not null and coalesce({p}, 0) <> 1) as against, count(*) filter (where {c} is not null and {p} = 1) as under from ccf_processed_data" for c, p in _GATES))
def gating_check(spark, d):
    """Labels set against the rule that a child needs a positive parent (G03): one scan for all pairs."""
    return annotate.gating_violations(table(spark, d, "ccf_processed_data"))


@query(f"with {UNITS} select doc_id, sentence_id, {', '.join(f'case when {p} = 1 then {c} end as {c}' for c, p in _GATES)} from units")
def gated_labels(spark, d):
    """Children kept only under a positive parent."""
    return annotate.gated(units(spark, d, *dict.fromkeys(x for g in _GATES for x in g))).select("doc_id", "sentence_id", *[c for c, _ in _GATES])


@query(f"with {UNITS} select doc_id, sentence_id, coalesce(economic_frame, regexp_matches(coalesce(sentences, ''), '{_LEX['economic_frame']}')::int) as economic_frame, economic_frame is null as filled from units")
def resumed_labels(spark, d):
    """Only rows whose label is missing are evaluated, the rest is kept."""
    u = units(spark, d, "economic_frame", "sentences")
    return u.select("doc_id", "sentence_id", annotate.resumed("economic_frame", F.coalesce("sentences", F.lit("")).rlike(_LEX["economic_frame"]).cast("int")), F.col("economic_frame").isNull().alias("filled"))


@query(f"with {ARTICLES} select doc_id, media, date, author from articles where media is not null order by media, date desc nulls last, doc_id")
def multi_key_sort(spark, d):
    """Several sort keys in both directions."""
    return articles(spark, d, "media", "date", "author").filter("media is not null").select("doc_id", "media", "date", "author").orderBy("media", F.desc_nulls_last("date"), "doc_id")


@query(f"with {ARTICLES} select doc_id, round(epoch(loaded_at - date) / 3600, 2) as hours from articles where date is not null and loaded_at is not null")
def hours_to_load(spark, d):
    """Hours between two timestamps, two decimals."""
    return articles(spark, d, "date").filter("date is not null and loaded_at is not null").select("doc_id", T.hours_between("date", "loaded_at").alias("hours"))

