"""Joins and set operations."""

from __future__ import annotations

from corpusloom.catalog.base import ARTICLES, UNITS, F, articles, query, table, units
from corpusloom.operators import joins, rows
from corpusloom.plans.taxonomy import CODES


@query(f"with {UNITS}, g as (select doc_id, sentence_id, max(urgency) as gold from ccf_processed_data where urgency is not null group by 1, 2) select doc_id, sentence_id, gold, economic_frame as predicted from g join units using (doc_id, sentence_id)")
def gold_lookup_join(spark, d):
    """Gold with the last prediction of the same composite key; keys without one are skipped."""
    g = table(spark, d, "ccf_processed_data").filter("urgency is not null").groupBy("doc_id", "sentence_id").agg(F.max("urgency").alias("gold"))
    return g.join(units(spark, d, "economic_frame").select("doc_id", "sentence_id", F.col("economic_frame").alias("predicted")), ["doc_id", "sentence_id"])


@query(f"with {UNITS}, a as (select doc_id, sentence_id, economic_frame as first from units where economic_frame is not null), b as (select doc_id, sentence_id, event as second, md5(concat_ws('-', doc_id, sentence_id, 'order')) as k from units where event is not null) select doc_id, sentence_id, first, second, row_number() over (order by k, doc_id, sentence_id) as seq from a join b using (doc_id, sentence_id)")
def coder_intersection(spark, d):
    """Units that both coders coded, in the second coder's order."""
    u = units(spark, d, "economic_frame", "event")
    a = u.filter("economic_frame is not null").select("doc_id", "sentence_id", F.col("economic_frame").alias("first"))
    b = u.filter("event is not null").select("doc_id", "sentence_id", F.col("event").alias("second"), F.md5(F.concat_ws("-", "doc_id", "sentence_id", F.lit("order"))).alias("k"))
    return rows.dense_ids(a.join(b, ["doc_id", "sentence_id"]), ["k", "doc_id", "sentence_id"], "seq").select("doc_id", "sentence_id", "first", "second", F.col("seq").cast("long"))


@query("""
with v as (select coalesce(source, '(none)') as source, count(*) as n_validation from just_1_sub_validation_en group by 1), t as (select coalesce(source, '(none)') as source, count(*) as n_train from just_1_sub_train_en group by 1)
select coalesce(v.source, t.source) as source, n_validation, n_train from v full join t on v.source = t.source""")
def outer_merge(spark, d):
    """Full join of two counts."""
    by = lambda t, n: table(spark, d, t).groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias(n))
    return by("just_1_sub_validation_en", "n_validation").join(by("just_1_sub_train_en", "n_train"), "source", "full")


@query("select t.number, t.code, coalesce(n, 0) as n from ccf_reliability_tiers t left join (" + " union all ".join(f"select '{c}' as code, sum({c}) as n from ccf_processed_data" for c in CODES) + ") u on u.code = t.code")
def spine_left_join(spark, d):
    """All 65 categories appear, absent ones with 0."""
    sums = table(spark, d, "ccf_processed_data").agg(*[F.sum(c).alias(c) for c in CODES]).unpivot([], CODES, "code", "n")  # one row per label
    return table(spark, d, "ccf_reliability_tiers").select("number", "code").join(joins.bounded(sums), "code", "left").select("number", "code", F.coalesce("n", F.lit(0)).alias("n"))


@query(r"""
with n as (select code as raw from ccf_reliability_tiers union all select category from ccf_reliability_tiers union all select 'models/' || code || '_EN.jsonl.model' from ccf_reliability_tiers union all select replace(category, ' ', '_') from ccf_reliability_tiers union all select 'Nothing of that name'),
k as (select raw, raw as k0, replace(raw, '_', ' ') as k1, regexp_extract(raw, '([^/]*?)(_EN|_FR)?(\.jsonl)?\.model$', 1) as k2 from n)
select raw, coalesce(a.number, b.number, c.number, e.number, 99) as number, coalesce(a.number, b.number, c.number, e.number) is null as unmapped from k left join ccf_reliability_tiers a on a.code = k0 left join ccf_reliability_tiers b on b.category = k0 left join ccf_reliability_tiers c on c.category = k1 left join ccf_reliability_tiers e on e.code = k2 and k2 <> ''""")
def normalized_labels(spark, d):
    """Names in several spellings brought to category numbers; unmapped ones get 99."""
    t = table(spark, d, "ccf_reliability_tiers")
    names = t.select(F.explode(F.array("code", "category", F.concat(F.lit("models/"), "code", F.lit("_EN.jsonl.model")), F.replace("category", F.lit(" "), F.lit("_")))).alias("raw"))
    names = names.union(spark.createDataFrame([("Nothing of that name",)], "raw string"))
    return joins.normalized(names, "raw", t.select("number", "code", "category"))


@query(f"with {ARTICLES}, l as (select lower(trim(media)) as k, max(region) as region from media_province where region is not null group by 1) select coalesce(region, '(unmapped)') as region, count(*) as n from articles left join l on lower(trim(articles.media)) = k group by 1")
def media_region(spark, d):
    """Outlets to regions by trimmed lower-case name; unmapped ones are counted, not lost."""
    return joins.with_region(articles(spark, d, "media"), table(spark, d, "media_province")).groupBy(F.coalesce("region", F.lit("(unmapped)")).alias("region")).agg(F.count("*").alias("n"))


@query("select doc_id, sentence_id, media from ccf_processed_data where (doc_id, sentence_id) in (select doc_id, sentence_id from ccf_sentence_embeddings)")
def semi_keys(spark, d):
    """Composite IN-list as a semi join."""
    return rows.matching(table(spark, d, "ccf_processed_data").select("doc_id", "sentence_id", "media"), table(spark, d, "ccf_sentence_embeddings").withColumn("sentence_id", F.col("sentence_id").cast("long")), ["doc_id", "sentence_id"])


@query("select p.doc_id, p.sentence_id from ccf_processed_data p where not exists (select 1 from ccf_sentence_embeddings e where e.doc_id = p.doc_id and e.sentence_id = p.sentence_id and e.doc_id <> 0 and e.sentence_id <> 0)")
def anti_keys(spark, d):
    """Composite anti join that never excludes sentence 0."""
    return rows.excluded(table(spark, d, "ccf_processed_data").select("doc_id", "sentence_id"), table(spark, d, "ccf_sentence_embeddings").select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id")), ["doc_id", "sentence_id"])


@query("select record_id from just_1_sub_train_en t where not exists (select 1 from just_1_sub_validation_en v where v.source = t.source and v.text = t.text)")
def anti_texts(spark, d):
    """Texts already used in the same group are left out."""
    return rows.excluded_texts(table(spark, d, "just_1_sub_train_en").select("record_id", "source", "text"), table(spark, d, "just_1_sub_validation_en").select("source", "text"), "source", "text").select("record_id")


@query(f"with {UNITS} select doc_id, sentence_id, coalesce(event, economic_frame) as economic_frame from units")
def update_from(spark, d):
    """Predictions merged into the wide table."""
    u = units(spark, d, "economic_frame", "event")
    new = u.select("doc_id", "sentence_id", F.col("event").alias("economic_frame"))
    return rows.merged(u.select("doc_id", "sentence_id", "economic_frame"), new, ["doc_id", "sentence_id"], "economic_frame")


@query(f"with {ARTICLES}, old as (select doc_id, min(loaded_at) as first_seen from ccf_full_data group by 1) select doc_id, 'delta' as side, words_count from articles where doc_id in (select doc_id from ccf_full_data group by 1 having count(distinct loaded_at) > 1) union all select doc_id, 'base', words_count from articles where doc_id not in (select doc_id from ccf_full_data group by 1 having count(distinct loaded_at) > 1)")
def delta_wins(spark, d):
    """Re-delivered articles replace earlier ones."""
    a = articles(spark, d, "words_count").select("doc_id", "words_count")
    again = table(spark, d, "ccf_full_data").groupBy("doc_id").agg(F.countDistinct("loaded_at").alias("n")).filter("n > 1").select("doc_id")
    delta = a.join(again, "doc_id", "left_semi").select("doc_id", F.lit("delta").alias("side"), "words_count")
    return rows.delta_wins(a.select("doc_id", F.lit("base").alias("side"), "words_count"), delta, ["doc_id"])


@query("select record_id, split, label from just_1_sub_validation_en union all select record_id, split, label from just_1_sub_train_en")
def row_union(spark, d):
    """Rows of two tables by column name."""
    return table(spark, d, "just_1_sub_validation_en").select("record_id", "split", "label").unionByName(table(spark, d, "just_1_sub_train_en").select("label", "split", "record_id"))


_FLIP = "substr(md5(concat_ws('-', doc_id, sentence_id, '{0}')), 1, 1) = '0'"
_SETS = "a as (select doc_id, sentence_id, list_filter([" + ", ".join(f"case when {c} = 1 then '{c}' end" for c in CODES) + "], lambda x: x is not null) as s, list_filter([" + ", ".join(f"case when ({c} = 1) <> ({_FLIP.format(c)}) then '{c}' end" for c in CODES) + "], lambda x: x is not null) as t from units)"


@query(f"with {UNITS}, {_SETS} select doc_id, sentence_id, list_sort(list_intersect(s, t)) as consensus, list_sort(list_distinct(list_concat(s, t))) as either from a")
def consensus_gold(spark, d):
    """Labels of both coders: intersection and union (U03, U04, M12); the second coder turns one in sixteen over."""
    flip = lambda c: F.substring(F.md5(F.concat_ws("-", "doc_id", "sentence_id", F.lit(c))), 1, 1) == "0"
    pick = lambda has: F.filter(F.array(*[F.when(has(c), F.lit(c)) for c in CODES]), lambda x: x.isNotNull())
    s, t = pick(lambda c: F.col(c) == 1), pick(lambda c: (F.col(c) == 1) != flip(c))
    u = units(spark, d, *CODES).select("doc_id", "sentence_id", s.alias("s"), t.alias("t"))
    return u.select("doc_id", "sentence_id", F.array_sort(joins.gold(F.col("s"), F.col("t"), "consensus")).alias("consensus"), F.array_sort(joins.gold(F.col("s"), F.col("t"), "union")).alias("either"))


@query("select t.number, t.code, u.n from (" + " union all ".join(f"select '{c}' as code, sum({c}) as n from ccf_processed_data" for c in CODES) + ") u join ccf_reliability_tiers t on replace(t.category, ' ', '_') = replace((select category from ccf_reliability_tiers x where x.code = u.code), ' ', '_')")
def normalized_merge(spark, d):
    """Counts under readable names with underscores, merged with the categories after normalisation."""
    t = table(spark, d, "ccf_reliability_tiers")
    sums = table(spark, d, "ccf_processed_data").agg(*[F.sum(c).alias(c) for c in CODES]).unpivot([], CODES, "code", "n")
    named = sums.join(t.select("code", F.replace("category", F.lit(" "), F.lit("_")).alias("raw")), "code").select("raw", "n")
    number = joins.normalized(named, "raw", t.select("number", "code", "category"), strict=True).select("raw", "number").distinct()
    return named.join(joins.bounded(number), "raw").join(t.select("number", "code"), "number").select("number", "code", "n")


@query("select raw, coalesce(category, raw) as readable from (select code as raw from ccf_reliability_tiers union all select 'Nothing of that name') left join ccf_reliability_tiers on code = raw")
def readable_labels(spark, d):
    """Readable names of labels; a label without one keeps its own."""
    t = table(spark, d, "ccf_reliability_tiers")
    names = t.select(F.col("code").alias("raw")).union(spark.createDataFrame([("Nothing of that name",)], "raw string"))
    return joins.readable(names, "raw", t.select("code", "category"))


@query("select p.doc_id from (select distinct doc_id from ccf_full_data) p where p.doc_id not in (select doc_id from ccf_processed_data where doc_id is not null)")
def articles_without_units(spark, d):
    """Set difference of keys."""
    return table(spark, d, "ccf_full_data").select("doc_id").distinct().join(table(spark, d, "ccf_processed_data").select("doc_id"), "doc_id", "left_anti")


@query("select r.r_name as region, n.n_name as nation, count(*) as n_orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2")
def star_join(spark, d):
    """Fact table with three dimensions; the small ones are broadcast by their size."""
    t = lambda n: table(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
