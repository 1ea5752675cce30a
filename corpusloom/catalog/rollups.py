"""Aggregations over units and articles."""

from __future__ import annotations

from pyspark.sql import Window

from corpusloom.catalog.base import ARTICLES, UNITS, F, articles, query, table, units
from corpusloom.operators import rollup, rows
from corpusloom.plans.taxonomy import CODES, FAMILIES, FRAMES

_P = [f"prop_{f}" for f in FRAMES]
_TOP = "case when greatest({0}) <= 0 then null {1} end".format(", ".join(_P), " ".join(f"when greatest({', '.join(_P)}) = prop_{f} then '{f}'" for f in FRAMES))
_TOTAL = " + ".join(_P)
_ENTROPY = f"case when {_TOTAL} > 0 then {' + '.join(f'case when {p} > 0 then -({p} / ({_TOTAL})) * ln({p} / ({_TOTAL})) else 0 end' for p in _P)} else 0 end"
_SHARES = "shares as (select doc_id, count(*) as n_sentences, count(*) filter (where language = 'EN') as n_sentences_en, count(*) filter (where language = 'FR') as n_sentences_fr, " + ", ".join(f"sum(coalesce({c}, 0)) / count(*) as prop_{c}" for c in CODES) + " from units where doc_id is not null group by doc_id)"
_KINDS = ", ".join(f"({' + '.join(f'(prop_{c} > 0)::int' for c in FAMILIES[k])}) as n_unique_{k}_subs" for k in ("messenger", "event", "solution"))
AGGREGATES = f"{UNITS}, {_SHARES}, aggregates as (select *, {_TOP} as top_frame, greatest({', '.join(_P)}) as top_frame_prop, {_ENTROPY} as entropy_frames, {_KINDS} from shares)"


def aggregates(spark, d):
    return rollup.article_aggregates(units(spark, d, "language", *CODES, by="doc_id"))


@query(f"with {UNITS} select language, count(*) as n from units group by 1")
def lang_counts(spark, d):
    """Units by language."""
    return units(spark, d, "language").groupBy("language").agg(F.count("*").alias("n"))


@query("select media, count(*) as n from ccf_full_data where media is not null group by 1 order by 2 desc, 1 limit 10")
def outlet_topn(spark, d):
    """Ten outlets with most rows (A26, O04): TakeOrderedAndProject."""
    return table(spark, d, "ccf_full_data").filter("media is not null").groupBy("media").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "media").limit(10)


@query(f"with {ARTICLES} select year(date)::int as year, count(*) as n from articles where date is not null group by 1 order by 1")
def year_counts(spark, d):
    """Articles by year."""
    return articles(spark, d, "date").filter("date is not null").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@query("select code, coalesce(n_en, 0)::bigint as n_en, coalesce(n_fr, 0)::bigint as n_fr from (" + " union all ".join(f"select '{c}' as code, sum(case when language = 'EN' then {c} end) as n_en, sum(case when language = 'FR' then {c} end) as n_fr from ccf_processed_data" for c in CODES) + ")")
def label_distribution_single_pass(spark, d):
    """130 conditional sums in one scan (A03): partial sums by language, then 65 columns turned into rows."""
    by = table(spark, d, "ccf_processed_data").groupBy("language").agg(*[F.sum(c).alias(c) for c in CODES])
    long = by.unpivot(["language"], CODES, "code", "n")
    pick = lambda x: F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"n_{x.lower()}")
    return long.groupBy("code").agg(pick("EN"), pick("FR"))


@query(f"with {AGGREGATES} select count(*) as n, round(avg(n_sentences), 6) as mean_sentences, round(stddev_samp(n_sentences), 6) as sd_sentences, round(quantile_cont(n_sentences, 0.5), 6) as median_sentences, round(avg(entropy_frames), 6) as mean_entropy from aggregates")
def descriptives(spark, d):
    """Count, mean, sample deviation and exact median."""
    return aggregates(spark, d).agg(
        F.count("*").alias("n"), F.round(F.avg("n_sentences"), 6).alias("mean_sentences"), F.round(F.stddev_samp("n_sentences"), 6).alias("sd_sentences"),
        F.round(F.percentile("n_sentences", 0.5), 6).alias("median_sentences"), F.round(F.avg("entropy_frames"), 6).alias("mean_entropy"),
    )


@query(f"with {AGGREGATES} select coalesce(top_frame, '(none)') as top_frame, count(*) as n, round(100.0 * count(*) / (select count(*) from aggregates), 6) as share from aggregates group by 1")
def top_frame_share(spark, d):
    """Share of each main frame in all articles, those without one included."""
    by = aggregates(spark, d).groupBy(F.coalesce("top_frame", F.lit("(none)")).alias("top_frame")).agg(F.count("*").alias("n"))
    return by.select("top_frame", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # a window over nine rows


@query("select code, language, n, round(n / t, 6) as share from (select code, language, sum(v) as n, count(*) as t from (" + " union all ".join(f"select '{c}' as code, coalesce(language, 'EN') as language, {c} as v from ccf_processed_data where {c} is not null" for c in CODES) + ") group by 1, 2)")
def label_usage(spark, d):
    """Use of the labels by language (A07); a missing language counts as EN."""
    u = table(spark, d, "ccf_processed_data").withColumn("language", F.coalesce("language", F.lit("EN")))
    by = rows.long_labels(u, ["language"], CODES).groupBy("code", "language").agg(F.sum("value").alias("n"), F.count("*").alias("t"))
    return by.select("code", "language", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""
with r as (select split, label from just_1_sub_validation_en union all select split, label from just_1_sub_train_en)
select split, count(*) filter (where label = 1) as positive, count(*) filter (where label = 0) as negative, count(*) filter (where label is null) as unlabelled from r group by 1""")
def class_counts(spark, d):
    """Classes by split, side by side."""
    r = table(spark, d, "just_1_sub_validation_en").select("split", "label").union(table(spark, d, "just_1_sub_train_en").select("split", "label"))
    return r.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


@query(f"with {UNITS} select code, language, value, count(*) as n from (" + " union all ".join(f"select '{c}' as code, language, {c} as value from units where {c} is not null" for c in CODES) + ") group by all")
def prediction_value_counts(spark, d):
    """Values of every label by language, NULL left out."""
    u = units(spark, d, "language", *CODES)
    sums = u.groupBy("language").agg(*[x for c in CODES for x in (F.count_if(F.col(c) == 0).alias(f"{c}|0"), F.count_if(F.col(c) == 1).alias(f"{c}|1"))])
    long = sums.unpivot(["language"], [f"`{c}|{v}`" for c in CODES for v in (0, 1)], "k", "n").filter("n > 0")
    return long.select(F.split("k", r"\|")[0].alias("code"), "language", F.split("k", r"\|")[1].cast("int").alias("value"), "n")


@query(f"with {AGGREGATES} select doc_id, n_sentences, n_sentences_en, n_sentences_fr, {', '.join(f'round(prop_{c}, 6) as prop_{c}' for c in CODES)}, top_frame, round(top_frame_prop, 6) as top_frame_prop, round(entropy_frames, 6) as entropy_frames, n_unique_messenger_subs, n_unique_event_subs, n_unique_solution_subs from aggregates")
def article_aggregates(spark, d):
    """Units rolled up to articles (A10-A13): one shuffle."""
    a = aggregates(spark, d)
    return a.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


@query(f"with {AGGREGATES} select year(date)::int as year, {', '.join(f'round(100 * avg(prop_{f}), 6) as {f}' for f in FRAMES)}, count(*) as n from aggregates join articles using (doc_id) where date is not null group by 1".replace("with units", f"with {ARTICLES}, units", 1))
def frames_by_year(spark, d):
    """Mean frame shares by year of publication."""
    a = aggregates(spark, d).join(articles(spark, d, "date").select("doc_id", "date").filter("date is not null"), "doc_id")
    return a.groupBy(F.year("date").alias("year")).agg(*[F.round(100 * F.avg(f"prop_{f}"), 6).alias(f) for f in FRAMES], F.count("*").alias("n"))


@query(f"with {AGGREGATES} select t.code as top_frame, t.tier_overall as tier, count(*) as n_articles, round(avg(a.top_frame_prop), 6) as mean_share from aggregates a join articles f using (doc_id) join ccf_reliability_tiers t on t.code = a.top_frame where t.tier_overall in ('A', 'B') group by 1, 2".replace("with units", f"with {ARTICLES}, units", 1))
def tier_join(spark, d):
    """Three-way join; the table of 65 tiers is broadcast."""
    t = table(spark, d, "ccf_reliability_tiers").filter("tier_overall in ('A', 'B')").select(F.col("code").alias("top_frame"), F.col("tier_overall").alias("tier"))
    a = aggregates(spark, d).select("doc_id", "top_frame", "top_frame_prop").join(articles(spark, d).select("doc_id"), "doc_id").join(F.broadcast(t), "top_frame")
    return a.groupBy("top_frame", "tier").agg(F.count("*").alias("n_articles"), F.round(F.avg("top_frame_prop"), 6).alias("mean_share"))


@query(f"with {AGGREGATES} select a.doc_id, t.code, round(case t.code {' '.join(f"when '{c}' then prop_{c}" for c in CODES)} end, 6) as share from aggregates a join ccf_reliability_tiers t on t.tier_overall = 'A'")
def tier_column_subset(spark, d):
    """Shares of the labels of tier A (P15): the codes come from the tier table, the other columns are pruned."""
    codes = [r["code"] for r in table(spark, d, "ccf_reliability_tiers").filter("tier_overall = 'A'").select("code").distinct().collect() if r["code"] in CODES]  # at most 65
    if not codes:
        return aggregates(spark, d).select("doc_id", F.lit("").alias("code"), F.lit(0.0).alias("share")).limit(0)
    chosen = aggregates(spark, d).select("doc_id", *[F.round(f"prop_{c}", 6).alias(c) for c in codes])
    return chosen.unpivot(["doc_id"], codes, "code", "share")


_NER = """
m as (select doc_id, sentence_id, case when json_valid(ner_entities) and json_type(ner_entities::json) = 'OBJECT' then ner_entities::json end as j from units where doc_id is not null),
e as (select doc_id, sentence_id, k as kind, unnest(from_json(coalesce(json_extract(j, '$.' || k), '[]'), '["VARCHAR"]')) as name from m, (values ('PER'), ('ORG'), ('LOC')) v(k) where j is not null)"""


@query(f"with {UNITS}, {_NER}, d as (select distinct doc_id from units where doc_id is not null) select doc_id, " + ", ".join(
    f"coalesce((select list_sort(list(distinct name)) from e where e.doc_id = d.doc_id and kind = '{k}'), []) as entities_{k.lower()}, coalesce((select count(distinct name) from e where e.doc_id = d.doc_id and kind = '{k}'), 0)::int as n_unique_{k.lower()}, coalesce((select count(distinct sentence_id) from e where e.doc_id = d.doc_id and kind = '{k}'), 0) as n_sentences_with_{k.lower()}" for k in ("PER", "ORG", "LOC")) + " from d")
def entity_rollup(spark, d):
    """Entities of each article, deduplicated, with counts."""
    return rollup.entity_rollup(units(spark, d, "ner_entities"))


@query(f"with {UNITS}, {_NER} select kind, name, n from (select kind, name, count(distinct doc_id) as n, row_number() over (partition by kind order by count(distinct doc_id) desc, name) as r from e where length(name) >= 2 and not regexp_matches(name, '^[[:punct:]\\s]+$') group by 1, 2) where r <= 10")
def entity_topk(spark, d):
    """Ten entities of each kind named by most articles."""
    n = rollup.entity_mentions(units(spark, d, "ner_entities")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 10").drop("r")


@query(f"with {UNITS} select count(distinct doc_id) as n_articles, count(distinct (doc_id, sentence_id)) as n_units, count(*) as n, count(distinct media) as n_outlets, count(*) filter (where sentences is null) as n_without_text from units")
def distinct_checks(spark, d):
    """Uniqueness and completeness."""
    return units(spark, d, "media", "sentences").agg(
        F.countDistinct("doc_id").alias("n_articles"), F.countDistinct("doc_id", "sentence_id").alias("n_units"), F.count("*").alias("n"), F.countDistinct("media").alias("n_outlets"), F.count_if(F.col("sentences").isNull()).alias("n_without_text"))


@query(f"with {AGGREGATES} select count(*) as n, count(*) filter (where top_frame is null) as without_frame, count(*) filter (where {' and '.join(f'prop_{c} between 0 and 1' for c in CODES)}) as in_range, count(*) filter (where top_frame_prop = greatest({', '.join(_P)}) and (top_frame is null or top_frame_prop > 0)) as largest from aggregates")
def integrity_checks(spark, d):
    """All shares between 0 and 1, main frame is the largest share (published checks)."""
    inside = F.lit(True)
    for c in CODES:
        inside &= F.col(f"prop_{c}").between(0, 1)
    largest = (F.col("top_frame_prop") == F.greatest(*_P)) & (F.col("top_frame").isNull() | (F.col("top_frame_prop") > 0))
    return aggregates(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("top_frame").isNull()).alias("without_frame"), F.count_if(inside).alias("in_range"), F.count_if(largest).alias("largest"))


@query("with l as (" + " union all ".join(f"select '{c}' as code, language, avg({c}) as m from ccf_processed_data where {c} is not null group by 2" for c in CODES) + ") select code, max(case when language = 'EN' then round(m, 6) end) as EN, max(case when language = 'FR' then round(m, 6) end) as FR from l group by 1")
def pivot_label_lang(spark, d):
    """Category by language, side by side (A24): the pivot's values are given, and a pair that comes twice stops the job."""
    l = rows.long_labels(table(spark, d, "ccf_processed_data"), ["language"]).groupBy("code", "language").agg(F.round(F.avg("value"), 6).alias("m"))
    return rollup.pivoted(l, "code", "language", ["EN", "FR"], "m")


@query(f"with {UNITS}, s as (" + " union all ".join(f"select '{c}' as code, language, sum({c}) as n from units where {c} is not null group by 2" for c in CODES) + ") select coalesce(language, 'ALL') as language, coalesce(code, 'ALL') as code, sum(n) as n from s group by grouping sets ((code, language), (code), ())")
def custom_order(spark, d):
    """Totals by grouping sets, in the order label, EN, FR, ALL."""
    l = rows.long_labels(units(spark, d, "language", *CODES), ["language"])
    g = l.groupingSets([["code", "language"], ["code"], []], "code", "language").agg(F.sum("value").alias("n"))
    out = g.select(F.coalesce("language", F.lit("ALL")).alias("language"), F.coalesce("code", F.lit("ALL")).alias("code"), "n")
    return out.orderBy(F.col("code") == "ALL", "code", F.when(F.col("language") == "EN", 0).when(F.col("language") == "FR", 1).otherwise(2))


@query("select distinct lower(trim(media)) as outlet, news_type from ccf_full_data where media is not null")
def distinct_outlets(spark, d):
    """Distinct pairs."""
    return table(spark, d, "ccf_full_data").filter("media is not null").select(F.lower(F.trim("media")).alias("outlet"), "news_type").distinct()


@query(f"with {UNITS} select doc_id, max(sentence_id) as last_sentence, max_by(md5(coalesce(sentences, '')), sentence_id) as last_md5 from units where doc_id is not null group by 1")
def last_unit(spark, d):
    """The row with the largest order key per group."""
    return units(spark, d, "sentences").filter("doc_id is not null").groupBy("doc_id").agg(F.max("sentence_id").alias("last_sentence"), F.max_by(F.md5(F.coalesce("sentences", F.lit(""))), "sentence_id").alias("last_md5"))

