"""Splits and samples."""

from __future__ import annotations

from corpusloom.catalog.base import UNITS, F, query, table, units
from corpusloom.operators import sampling
from corpusloom.plans.taxonomy import CODES

_KEY = "md5(concat_ws('|', record_id, '42'))"
_REC = "r as (select record_id, split, label from just_1_sub_validation_en where label is not null union all select record_id, split, label from just_1_sub_train_en where label is not null)"


@query(f"""
with {_REC}, s as (select split, count(*) filter (where label = 1) p, count(*) filter (where label = 0) n from r group by 1),
v as (select split, p, n, least(greatest(ceil(round(0.1 * p, 9)), ceil(round(0.2 * p, 9))), p) as vp from s),
l as (select split, vp, least(greatest(ceil(round(0.1 * n, 9)), ceil(round(0.2 * (p + n), 9)) - vp), n) as vn from v)
select record_id, split, label, case when row_number() over (partition by split, label order by {_KEY}, record_id) <= case when label = 1 then vp else vn end then 'validation' else 'train' end as part from r join l using (split)""")
def split_train_val(spark, d):
    """Stratified split with a floor for the rarer class."""
    r = table(spark, d, "just_1_sub_validation_en").select("record_id", "split", "label").union(table(spark, d, "just_1_sub_train_en").select("record_id", "split", "label"))
    return sampling.split_by_class(r, ["split"], "label", "record_id")


_W = " + ".join(f"case when {c} = 1 then 1.0::double / sqrt(greatest((select sum({c}) from units), 1)) else 0.0::double end" for c in CODES)


@query(f"with {UNITS}, w as (select doc_id, sentence_id, {_W} as w from units) select doc_id, sentence_id, round(case when w > 0 then w else (select min(w) from w where w > 0) end, 9) as weight from w")
def row_weights(spark, d):
    """Root-inverse weights over all labels."""
    return sampling.row_weights(units(spark, d, *CODES).select("doc_id", "sentence_id", *CODES), CODES).select("doc_id", "sentence_id", F.round("weight", 9).alias("weight"))


_U = "((('0x' || substr(md5(concat_ws('|', doc_id, sentence_id, '42')), 1, 13))::bigint::double + 0.5) / 4503599627370496)"


@query(f"with {UNITS}, w as (select doc_id, sentence_id, {_W} as w from units), x as (select doc_id, sentence_id, case when w > 0 then w else (select min(w) from w where w > 0) end as w from w) select doc_id, sentence_id from x order by ln({_U}) / w desc, doc_id, sentence_id limit 1000")
def weighted_sample(spark, d):
    """A thousand units without replacement, rare labels preferred."""
    w = sampling.row_weights(units(spark, d, *CODES).select("doc_id", "sentence_id", *CODES), CODES)
    return sampling.weighted_sample(w, 1000, "weight", "doc_id", "sentence_id").select("doc_id", "sentence_id")


@query(f"with {UNITS} select doc_id, sentence_id, language from units qualify row_number() over (partition by language order by md5(concat_ws('|', doc_id, sentence_id, '42')), doc_id, sentence_id) <= 2000")
def first_round_sample(spark, d):
    """Two thousand units of each language in a fixed random order."""
    return sampling.first_per_group(units(spark, d, "language").select("doc_id", "sentence_id", "language"), "language", 2000, "doc_id", "sentence_id")


@query()
def sample_caps(spark, d):
    """Sample with a floor and a ceiling per label (X04-X08); the adjusting loop isn't SQL."""
    u = units(spark, d, "language", *CODES).select("doc_id", "sentence_id", F.coalesce("language", F.lit("EN")).alias("language"), *CODES).filter("doc_id is not null and sentence_id is not null")
    counts = {r["language"]: r["count"] for r in u.groupBy("language").count().collect()}  # as many rows as languages
    out = None
    for language, quota in sampling.language_quotas(counts, sampling.upscaled(600, len(CODES), 40)).items():
        part = sampling.constrained_sample(u.filter(F.col("language") == language), ["doc_id", "sentence_id"], CODES, quota, floor=20, ceiling=0.5).withColumn("language", F.lit(language))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else u.limit(0)


@query("""
with r as (select record_id, label from just_1_sub_train_en where label is not null), n as (select label, count(*) as k from r group by 1), t as (select max(k) as top from n),
x as (select record_id, label, (top // k)::bigint + case when ((('0x' || substr(md5(concat_ws('|', record_id, '42')), 1, 13))::bigint::double + 0.5) / 4503599627370496) < (top % k) / k then 1 else 0 end as times from r join n using (label), t)
select record_id, label, unnest(range(1, times + 1)) as draw from x""")
def oversampled(spark, d):
    """The smaller class drawn several times."""
    return sampling.oversampled(table(spark, d, "just_1_sub_train_en").select("record_id", "label"), "label", "record_id").select("record_id", "label", F.col("draw").cast("long"))


@query("select label, count(*) as n, round(1.0 / count(*), 9) as weight from just_1_sub_train_en where label is not null group by 1")
def inverse_frequency(spark, d):
    """Class counts and their inverse."""
    return table(spark, d, "just_1_sub_train_en").filter("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.round(1.0 / F.count("*"), 9).alias("weight"))
