"""Agreement, evaluation and tiers."""

from __future__ import annotations

from corpusloom.catalog.base import UNITS, F, query, table, units
from corpusloom.functions import metrics
from corpusloom.functions import text as T
from corpusloom.functions.metrics import evaluation, fallback_alpha
from corpusloom.operators import agreement, joins, provenance, rows
from corpusloom.plans.taxonomy import CODES

# The second coder: the first one's labels, one in sixteen turned over, by digest of the key.
_FLIP = "substr(md5(concat_ws('-', doc_id, sentence_id, code)), 1, 1) = '0'"
_LONG = "lab as (" + " union all ".join(f"select doc_id, sentence_id, language, date, '{c}' as code, {c} as first from units where {c} is not null" for c in CODES) + ")"
_PAIRS = f"{UNITS}, {_LONG}, pairs as (select *, case when {_FLIP} then 1 - first else first end as second from lab)"
_CELLS = "count(*) filter (where first = 1 and second = 1)::double a, count(*) filter (where first = 1 and second = 0)::double b, count(*) filter (where first = 0 and second = 1)::double c, count(*) filter (where first = 0 and second = 0)::double d"
_STATS = """round((a + d) / n, 6) as percent_agreement,
  round(case when pe < 1 then ((a + d) / n - pe) / (1 - pe) end, 6) as cohens_kappa,
  round(case when pie < 1 then ((a + d) / n - pie) / (1 - pie) else 1.0 end, 6) as scotts_pi,
  round(case when n1 > 0 and n0 > 0 then 2 * (a + d) / n - 1 else 1.0 end, 6) as s_coefficient,
  round(((a + d) / n - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)), 6) as gwet_ac1,
  round(case when k1 and k2 then case when b + c = 0 then 1.0 else -1.0 end when k1 or k2 then (a + d) / n else 1 - (b + c) * (2 * n - 1) / (n0 * n1) end, 6) as krippendorff_alpha,
  round(case when 2 * a + b + c > 0 then 2 * a / (2 * a + b + c) else 0.0 end, 6) as f1_agreement, round((a + b) / n, 6) as prevalence_1, round((a + c) / n, 6) as prevalence_2"""
_TERMS = "select *, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n) as pe, p * p + (1 - p) * (1 - p) as pie, (a + b = 0) or (c + d = 0) as k1, (a + c = 0) or (b + d = 0) as k2 from (select *, a + b + c + d as n, 2 * a + b + c as n1, 2 * d + b + c as n0, (2 * a + b + c) / (2 * (a + b + c + d)) as p from cells where a + b + c + d > 0)"


def pairs(spark, d):
    """(doc_id, sentence_id, language, date, code, first, second) for all labels."""
    long = rows.long_labels(units(spark, d, "language", "date", *CODES), ["doc_id", "sentence_id", "language", "date"], CODES, "first")
    flip = F.substring(F.md5(F.concat_ws("-", "doc_id", "sentence_id", "code")), 1, 1) == "0"
    return long.withColumn("second", F.when(flip, 1 - F.col("first")).otherwise(F.col("first")))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1) select code, n::bigint as n, {_STATS} from ({_TERMS})")
def agreement_per_label(spark, d):
    """Nine agreement statistics of every label from four counts."""
    return agreement.per_label(pairs(spark, d))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1), st as (select {_STATS} from ({_TERMS})), po as (select sum(a) a, sum(b) b, sum(c) c, sum(d) d from cells) select (select count(*) from st) as n_labels, " + ", ".join(f"(select round(avg({m}), 6) from st) as {m}" for m in ("percent_agreement", "cohens_kappa", "scotts_pi", "s_coefficient", "f1_agreement")) + ", round(1 - (b + c) * (2 * (a + b + c + d) - 1) / ((2 * d + b + c) * (2 * a + b + c)), 6) as krippendorff_alpha from po")
def agreement_overall(spark, d):
    """Means over labels, and alpha pooled over all of them."""
    return agreement.overall(pairs(spark, d))


_SEQ = f"{_PAIRS}, s as (select doc_id, sentence_id, row_number() over (order by doc_id, sentence_id) as seq from (select distinct doc_id, sentence_id from pairs))"


@query(f"with {_SEQ}, q as (select *, ceil(seq / 100.0)::bigint as step from pairs join s using (doc_id, sentence_id)), g as (select code, step, {_CELLS} from q group by 1, 2), cells as (select code, step, sum(a) over w a, sum(b) over w b, sum(c) over w c, sum(d) over w d from g window w as (partition by code order by step)) select code, step * 100 as n_units, percent_agreement, cohens_kappa, s_coefficient, f1_agreement from (select code, step, {_STATS} from ({_TERMS})) where step * 100 <= (select max(seq) from s)")
def agreement_progression(spark, d):
    """Statistics of growing prefixes, every 100 units."""
    p = pairs(spark, d)
    order = rows.dense_ids(p.select("doc_id", "sentence_id").distinct(), ["doc_id", "sentence_id"], "seq")
    return agreement.progression(p.join(order, ["doc_id", "sentence_id"]), "seq")


@query(f"with {_SEQ}, q as (select *, case when seq <= 600 then 'before' else 'after' end as part from pairs join s using (doc_id, sentence_id)), cells as (select code, part, {_CELLS} from q group by 1, 2) select code, part, n::bigint as n, {_STATS} from ({_TERMS})")
def agreement_before_after(spark, d):
    """The first 600 units against the rest."""
    p = pairs(spark, d)
    order = rows.dense_ids(p.select("doc_id", "sentence_id").distinct(), ["doc_id", "sentence_id"], "seq")
    parts = p.join(order, ["doc_id", "sentence_id"]).withColumn("part", F.when(F.col("seq") <= 600, "before").otherwise("after"))
    return agreement.per_label(parts, ["code", "part"])


_EVAL = """round(case when a + c > 0 then a / (a + c) else 0 end, 6) as precision_1, round(case when a + b > 0 then a / (a + b) else 0 end, 6) as recall_1, round(f1, 6) as f1_1,
  round(case when d + b > 0 then d / (d + b) else 0 end, 6) as precision_0, round(case when d + c > 0 then d / (d + c) else 0 end, 6) as recall_0, round(f0, 6) as f1_0,
  round((f1 + f0) / 2, 6) as f1_macro, round((a + d) / n, 6) as f1_micro, round(((a + b) * f1 + (c + d) * f0) / n, 6) as f1_weighted, (a + b)::bigint as support_1, (c + d)::bigint as support_0"""
_F = "select *, a + b + c + d as n, case when 2 * a + b + c > 0 then 2 * a / (2 * a + b + c) else 0 end as f1, case when 2 * d + b + c > 0 then 2 * d / (2 * d + b + c) else 0 end as f0 from cells where a + b + c + d > 0"


@query(f"with {_PAIRS}, cells as (select coalesce(code, 'ALL') as code, coalesce(language, 'ALL') as language, {_CELLS} from pairs group by grouping sets ((code, language), (code), (language), ())) select code, language, {_EVAL} from ({_F})")
def confusion_wide(spark, d):
    """Precision, recall and F1 by label and language with ALL rows: one aggregate with grouping sets."""
    return agreement.evaluated(pairs(spark, d))


_DECADE = r"case when regexp_matches(date, '^\d{4}([-/]|$)') then substr(date, 1, 3) || '0s' when regexp_matches(date, '^\d{2}-\d{2}-\d{4}$') then substr(date, 7, 3) || '0s' end"


@query(f"with {_PAIRS}, cells as (select code, language, {_DECADE} as decade, {_CELLS} from pairs where {_DECADE} is not null group by 1, 2, 3) select code, language, decade, {_EVAL} from ({_F}) where a + b > 0")
def drift_by_decade(spark, d):
    """Evaluation by decade, unknown dates left out, only where there are positives."""
    p = pairs(spark, d).withColumn("decade", T.period(T.year_of("date"), "decade")).filter("decade <> 'Unknown'")
    return agreement.contingency(p, ["code", "language", "decade"]).filter("a + b > 0").select("code", "language", "decade", *evaluation().values())


@query(f"with {_PAIRS}, cells as (select coalesce(decade, 'ALL') as decade, coalesce(language, 'ALL') as language, {_CELLS} from (select *, {_DECADE} as decade from pairs where {_DECADE} is not null) group by grouping sets ((decade, language), (decade), (language), ())) select decade, language, n::bigint as n, round((f1 + f0) / 2, 6) as f1_macro from ({_F})")
def pooled_f1_by_decade(spark, d):
    """Macro F1 of one pooled matrix for each decade and language, and over all of either."""
    p = pairs(spark, d).withColumn("decade", T.period(T.year_of("date"), "decade")).filter("decade <> 'Unknown' and second is not null")
    cell = p.groupingSets([["decade", "language"], ["decade"], ["language"], []], "decade", "language").agg(*metrics.cells("first", "second"), F.grouping("language").alias("g"))
    language = F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("language", F.lit("ALL")))
    return cell.filter("a + b + c + d > 0").select(F.coalesce("decade", F.lit("ALL")).alias("decade"), language.alias("language"), F.expr("a + b + c + d").alias("n"), evaluation()["f1_macro"])


@query(f"with {_PAIRS}, cells as (select {_CELLS} from pairs) select round((f1 + f0) / 2, 6) as f1_macro, abs((f1 + f0) / 2 - 0.866) <= 0.005 as as_published from ({_F})")
def published_f1_check(spark, d):
    """Whether the pooled macro F1 over everything lies within 0.005 of the published 0.866 (M16); the caller decides what to do."""
    c = agreement.contingency(pairs(spark, d), [])
    return agreement.within(c.select(evaluation(rounded=False)["f1_macro"]), "f1_macro", 0.866, 0.005, "as_published").withColumn("f1_macro", F.round("f1_macro", 6))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1) select code, n::bigint as n, (a + b)::bigint as n_first, (a + c)::bigint as n_second, round((a + b) / n, 6) as prevalence_1, round((a + c) / n, 6) as prevalence_2 from ({_F})")
def coder_counts(spark, d):
    """Positive labels of each coder, and their shares."""
    return agreement.coder_counts(pairs(spark, d))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1) select code, round(case when n1 > 0 and n0 > 0 then 1 - (b + c) * 2 * n / (n0 * n1) else 1.0 end, 6) as alpha from (select *, a + b + c + d as n, 2 * a + b + c as n1, 2 * d + b + c as n0 from cells) where n > 0")
def uncorrected_alpha(spark, d):
    """Nominal alpha without the correction for small samples."""
    return agreement.contingency(pairs(spark, d), ["code"]).select("code", fallback_alpha())


@query(f"with {_PAIRS}, cells as (select language, {_CELLS} from pairs group by 1) select language, n::bigint as n, round((f1 + f0) / 2, 6) as f1_macro from ({_F})")
def pooled_macro_f1(spark, d):
    """Macro F1 on one pooled matrix."""
    c = agreement.contingency(pairs(spark, d), ["language"])
    return c.select("language", F.expr("a + b + c + d").alias("n"), evaluation()["f1_macro"])


@query(f"with {_SEQ}, q as (select *, unnest(['full', case when seq <= 600 then 'before' else 'after' end]) as part from pairs join s using (doc_id, sentence_id)), cells as (select code, part, {_CELLS} from q group by 1, 2), r as (select code, part, {_STATS} from ({_TERMS})) select t.number, t.code, " + ", ".join(f"max(case when part = '{x}' then {m} end) as {m}_{x}" for x in ("full", "before", "after") for m in ("cohens_kappa", "s_coefficient", "krippendorff_alpha")) + " from ccf_reliability_tiers t left join r using (code) group by 1, 2")
def reliability_by_phase(spark, d):
    """Agreement of each category over all units, the first 600 and the rest (M20); a label without a category aborts."""
    p = pairs(spark, d)
    order = rows.dense_ids(p.select("doc_id", "sentence_id").distinct(), ["doc_id", "sentence_id"], "seq")
    cells = agreement.phase_cells(p.join(order, ["doc_id", "sentence_id"]), "seq", 600)
    return agreement.per_category(cells, table(spark, d, "ccf_reliability_tiers"), ["cohens_kappa", "s_coefficient", "krippendorff_alpha"])


_TIER = "case when f1_macro_all is null then 'no_data' when f1_macro_all < 0.60 then 'C' when cohens_kappa_blind_phase < 0.40 then 'C' when f1_macro_all >= 0.80 and (cohens_kappa_blind_phase is null or cohens_kappa_blind_phase >= 0.60) then 'A' else 'B' end"
_OUT = ["canada", "urgency"]


@query(f"select number, code, case when code in ('canada', 'urgency') then 'C' else {_TIER} end as tier, coalesce(f1_macro_all >= 0.70 and cohens_kappa_blind_phase < 0.40, false) as paradox, case when code in ('canada', 'urgency') then 'excluded' end as exclusion_reason from ccf_reliability_tiers")
def tiers(spark, d):
    """Tier ladder, paradox flag and exclusions."""
    return agreement.tiered(table(spark, d, "ccf_reliability_tiers"), _OUT).select("number", "code", "tier", "paradox", "exclusion_reason")


@query(f"select tier, coalesce(n, 0) as n from (values ('A'), ('B'), ('C'), ('no_data')) v(tier) left join (select {_TIER} as t, count(*) as n from ccf_reliability_tiers group by 1) on t = tier")
def tier_counts(spark, d):
    """Tier counts, absent tiers with 0."""
    n = table(spark, d, "ccf_reliability_tiers").groupBy(agreement.tier("f1_macro_all", "cohens_kappa_blind_phase").alias("tier")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(t,) for t in ("A", "B", "C", "no_data")], "tier string").join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1), r as (select code, n::bigint as n, {_STATS} from ({_TERMS})) select t.number, t.code, r.n, r.cohens_kappa, t.tier_overall from ccf_reliability_tiers t left join r using (code)")
def per_category_reliability(spark, d):
    """Category spine with measured agreement, absent ones kept."""
    return table(spark, d, "ccf_reliability_tiers").select("number", "code", "tier_overall").join(joins.bounded(agreement.per_label(pairs(spark, d)).select("code", "n", "cohens_kappa")), "code", "left").select("number", "code", "n", "cohens_kappa", "tier_overall")


@query("select language, round(avg(f1), 6) as mean_f1, count(*) as n from (select 'ALL' as language, f1_macro_all as f1 from ccf_reliability_tiers union all select 'TOP', f1_macro_all from ccf_reliability_tiers where tier_overall = 'A') where f1 is not null group by 1")
def best_scores(spark, d):
    """Averages of scores by group and over all, NULL left out."""
    t = table(spark, d, "ccf_reliability_tiers").filter("f1_macro_all is not null")
    each = t.select(F.explode(F.when(F.col("tier_overall") == "A", F.array(F.lit("ALL"), F.lit("TOP"))).otherwise(F.array(F.lit("ALL")))).alias("language"), F.col("f1_macro_all").alias("f1"))
    return each.groupBy("language").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.count("*").alias("n"))


@query("""
with g as (select user_id, ts, sum(case when ts - p > interval 6 hours then 1 else 0 end) over (partition by user_id order by ts range unbounded preceding) as block from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events)),
b as (select user_id, block::bigint as block, count(*) as n, min(ts) as first, max(ts) as last from g group by 1, 2)
select user_id, block, n, first, last, round(epoch(last - first) / 3600, 2) as hours from b qualify row_number() over (partition by user_id order by n desc, block) = 1""")
def densest_block(spark, d):
    """Blocks of activity without a gap of six hours; the fullest one per user."""
    return provenance.densest_blocks(table(spark, d, "events"), "user_id", "ts")


@query("""
with l as (select user_id, list(struct_pack(e := event_id, s := value) order by event_id) as log from events where value is not null group by 1),
r as (select user_id, list_reduce(list_transform(log, lambda x: struct_pack(kept := [x.e], best := x.s)), lambda acc, x: case when x.best > acc.best + 1e-6 then struct_pack(kept := list_concat(acc.kept, x.kept), best := x.best) else acc end) as a from l)
select user_id, a.kept as kept, a.best as best from r""")
def record_epochs(spark, d):
    """Scores that beat the best one kept so far by more than 1e-6."""
    return provenance.record_epochs(table(spark, d, "events"), "user_id", "event_id", "value")


@query("select user_id, round(regr_slope(value, event_id), 6) as slope, round(regr_intercept(value, event_id), 6) as intercept, round(avg(value), 6) as mean, count(*) as n from events where value is not null group by 1")
def trend_slope(spark, d):
    """Least-squares line and mean."""
    return provenance.trend(table(spark, d, "events"), "event_id", "value", ["user_id"])


@query("select event_id, round(p, 6) as p_1, case when p > 0.5 then 1 else 0 end as label from (select event_id, 1 / (1 + exp(event_id % 7 - value / 10)) as p from events where value is not null)")
def class_scores(spark, d):
    """Softmax over the scores of two classes, and the class with the highest one, the first of equal ones."""
    e = table(spark, d, "events").filter("value is not null").withColumn("p", metrics.softmax(F.array((F.col("event_id") % 7).cast("double"), F.col("value") / 10)))
    return e.select("event_id", F.round(F.get("p", 1), 6).alias("p_1"), metrics.argmax("p").alias("label"))


@query(f"with {_PAIRS}, cells as (select code, {_CELLS} from pairs group by 1) select code, round(0.98 * f1 + 0.02 * (f1 + f0) / 2, 6) as combined from ({_F})")
def combined_f1(spark, d):
    """Score that a training epoch is chosen by: 0.98 of the positive class's F1 and 0.02 of the macro F1 (F16)."""
    e = evaluation(rounded=False)
    return agreement.contingency(pairs(spark, d), ["code"]).select("code", F.round(metrics.combined(e["f1_1"], e["f1_macro"]), 6).alias("combined"))


@query("select user_id, event_type as phase, max(event_id) as last, max_by(value, event_id) as last_value, round(avg(value), 6) as mean from events where event_type is not null group by 1, 2")
def phase_ends(spark, d):
    """Largest order key, its row and the mean of each phase."""
    e = table(spark, d, "events").filter("event_type is not null")
    return e.groupBy("user_id", F.col("event_type").alias("phase")).agg(F.max("event_id").alias("last"), F.max_by("value", "event_id").alias("last_value"), F.round(F.avg("value"), 6).alias("mean"))


@query("select user_id, count(*) as n, min(ts) as first, max(ts) as last, round(epoch(max(ts) - min(ts)) / 3600, 2) as hours from events where ts is not null group by 1")
def campaign_span(spark, d):
    """From the first to the last entry of each log."""
    return provenance.span(table(spark, d, "events"), "user_id", "ts")

