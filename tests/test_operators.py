import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import metrics
from corpusloom.functions import text as T
from corpusloom.operators import agreement, annotate, joins, provenance, rollup, rows, sampling, vectors
from corpusloom.plans.taxonomy import CODES, FRAMES, NUMBER, PARENT


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_taxonomy():
    assert len(CODES) == 65 and NUMBER["urgency"] == 65 and PARENT["pol_action"] == "political_frame" and len(FRAMES) == 8


def test_latest_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (None, "c", 1), (2, "d", None)], "k int, v string, t int")
    assert values(rows.latest(df, ["k"], "t"), "k", "v") == sorted([(1, "b"), (None, "c"), (2, "d")], key=repr)
    assert rows.latest(df.limit(0), ["k"], "t").count() == 0


def test_delta_wins_and_merge(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old"), (2, "old")], "k int, v string")
    delta = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert values(rows.delta_wins(base, delta, ["k"]), "k", "v") == [(1, "old"), (2, "new"), (3, "new")]
    new = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert values(rows.merged(base.distinct(), new, ["k"], "v"), "k", "v") == [(1, "old"), (2, "x")]


def test_excluded_keeps_sentence_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id int, sentence_id int")
    assert values(rows.excluded(df, df, ["doc_id", "sentence_id"]), "doc_id", "sentence_id") == sorted([(1, 0), (None, 1)], key=repr)


def test_dense_ids(spark):
    df = spark.createDataFrame([(c,) for c in "dbca"], "v string").repartition(3)
    assert values(rows.dense_ids(df, ["v"], "id"), "id", "v") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows.dense_ids(df.limit(0), ["v"], "id").count() == 0


@pytest.mark.parametrize("payload", [0, 192])
def test_dense_ids_of_a_million_rows(spark, payload):
    n = 1_000_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("v"), F.repeat(F.lit("x"), payload).alias("payload"))
    out = rows.dense_ids(df, ["v"], "id").agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.sum(F.length("payload"))).first()
    assert tuple(out) == (n, n, 1, n, n * payload)


def test_units(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "One."), (4, "A b. C d! E?")], "k int, t string").select("k", T.two_sentence_units(T.sentences("t")).alias("u"))
    assert values(df, "k", "u") == [(1, [""]), (2, [""]), (3, ["One."]), (4, ["A b.", "A b. C d!", "C d! E?"])]


def test_dates_and_periods(spark):
    df = spark.createDataFrame([("2001-03-04",), ("2001/03/04",), ("03-04-2001",), ("2001",), ("13-40-2001",), ("",), (None,)], "d string")
    out = {r[0]: r[1:] for r in df.select("d", T.parsed_date("d"), T.year_of("d"), T.period(T.year_of("d"), "decade"), T.period(T.year_of("d"), "five_years")).collect()}
    day = dt.date(2001, 3, 4)
    assert out["2001-03-04"] == out["2001/03/04"] == out["03-04-2001"] == (day, 2001, "2000s", "2000-2004")
    assert out["2001"] == (None, 2001, "2000s", "2000-2004") and out[""] == out[None] == (None, None, "Unknown", "Unknown")
    assert out["13-40-2001"][0] is None
    with pytest.raises(ValueError):
        T.period("y", "week")


def coded(spark, *cells):
    data = [("x", *p) for (a, b, c, d) in cells for p in [(1, 1)] * a + [(1, 0)] * b + [(0, 1)] * c + [(0, 0)] * d]
    return spark.createDataFrame(data + [("x", None, 1)], "code string, first int, second int")


def test_agreement_degenerate(spark):
    one = lambda *c: agreement.per_label(coded(spark, c)).first().asDict()
    same = one(0, 0, 0, 5)
    assert same["cohens_kappa"] is None and same["scotts_pi"] == 1.0 and same["s_coefficient"] == 1.0 and same["krippendorff_alpha"] == 1.0 and same["n"] == 5
    assert one(0, 5, 0, 0)["krippendorff_alpha"] == -1.0
    assert one(0, 2, 0, 6)["krippendorff_alpha"] == 0.75
    perfect = one(3, 0, 0, 3)
    assert perfect["cohens_kappa"] == perfect["krippendorff_alpha"] == perfect["f1_agreement"] == 1.0
    m = one(20, 5, 10, 65)
    assert m["percent_agreement"] == 0.85 and m["s_coefficient"] == 0.7 and m["cohens_kappa"] == round((0.85 - (0.25 * 0.3 + 0.75 * 0.7)) / (1 - (0.25 * 0.3 + 0.75 * 0.7)), 6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=4, max_size=4).filter(lambda c: sum(c) > 0))
def test_kappa_symmetric_and_micro_is_accuracy(spark, c):
    a, b, x, d = c
    first = agreement.per_label(coded(spark, (a, b, x, d))).first()
    second = agreement.per_label(coded(spark, (a, x, b, d))).first()
    assert first["cohens_kappa"] == second["cohens_kappa"] and first["krippendorff_alpha"] == second["krippendorff_alpha"]
    e = agreement.evaluated(coded(spark, (a, b, x, d)).withColumn("language", F.lit("EN"))).filter("code = 'x' and language = 'EN'").first()
    assert e["f1_micro"] == round((a + d) / (a + b + x + d), 6) and e["support_1"] + e["support_0"] == a + b + x + d


def test_tiers(spark):
    df = spark.createDataFrame([(None, None), (0.59, 0.9), (0.6, 0.39), (0.6, None), (0.8, None), (0.8, 0.6), (0.8, 0.59), (0.7, 0.3)], "f double, k double")
    assert [r[0] for r in df.select(agreement.tier("f", "k")).collect()] == ["no_data", "C", "C", "B", "A", "A", "B", "C"]
    assert [r[0] for r in df.select(agreement.paradox("f", "k")).collect()] == [False] * 7 + [True]
    t = agreement.tiered(spark.createDataFrame([("canada", 0.9, 0.9)], "code string, f1_macro_all double, cohens_kappa_blind_phase double"), ["canada"]).first()
    assert t["tier"] == "C" and t["exclusion_reason"] == "excluded"


def test_gold_strategies(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert df.select(joins.gold(F.col("x"), F.col("y"))).first()[0] == ["b"]
    assert sorted(df.select(joins.gold(F.col("x"), F.col("y"), "union")).first()[0]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        joins.gold(F.col("x"), F.col("y"), "vote")


def test_region_strict(spark):
    a = spark.createDataFrame([(" The Star",), (None,)], "media string")
    look = spark.createDataFrame([("the star", "Ontario"), ("Total", None)], "media string, region string")
    assert values(joins.with_region(a, look), "region") == sorted([("Ontario",), (None,)], key=repr)
    with pytest.raises(Exception):  # noqa: B017
        joins.with_region(a, look, strict=True).collect()


def units_frame(spark, *rows_):
    base = {c: None for c in CODES}
    return spark.createDataFrame([{**base, "doc_id": k, "sentence_id": s, "language": "EN", "ner_entities": j, **v} for k, s, j, v in rows_], ", ".join(["doc_id long", "sentence_id long", "language string", "ner_entities string", *[f"{c} int" for c in CODES]]))


def test_rollup(spark):
    df = units_frame(spark, (1, 1, '{"PER": ["A B", "A B"], "LOC": ["X"]}', {"economic_frame": 1, "political_frame": 1, "msg_legal": 1}), (1, 2, '{"PER": [', {"economic_frame": 1, "political_frame": 1}), (2, 1, None, {}), (None, 1, None, {}))
    a = {r["doc_id"]: r for r in rollup.article_aggregates(df).collect()}
    assert a[1]["top_frame"] == "economic_frame" and a[1]["prop_economic_frame"] == 1.0 and a[1]["n_unique_messenger_subs"] == 1 and abs(a[1]["entropy_frames"] - 0.6931471805599453) < 1e-12
    assert a[2]["top_frame"] is None and a[2]["entropy_frames"] == 0 and set(a) == {1, 2}
    e = {r["doc_id"]: r for r in rollup.entity_rollup(df).collect()}
    assert e[1]["entities_per"] == ["A B"] and e[1]["n_unique_loc"] == 1 and e[1]["n_sentences_with_per"] == 1 and e[2]["entities_org"] == []
    assert values(rollup.entity_mentions(df), "kind", "name", "doc_id") == [("PER", "A B", 1)]


def test_gating(spark):
    df = units_frame(spark, (1, 1, None, {"economic_frame": 0, "eco_cost": 1}), (1, 2, None, {"economic_frame": 1, "eco_cost": 0}), (1, 3, None, {"eco_cost": 1}))
    assert values(annotate.gated(df), "sentence_id", "eco_cost") == sorted([(1, None), (2, 0), (3, None)], key=repr)
    assert annotate.gating_violations(df).filter("code = 'eco_cost'").first()[1:] == (2, 1)
    lab = annotate.by_lexicon(spark.createDataFrame([("the cost of a tariff",), ("a calm day",), (None,)], "unit string"), "unit", annotate.LEXICON)
    assert values(lab, "economic_frame", "eco_cost") == sorted([(1, 1), (0, None), (0, None)], key=repr)


def test_inference_falls_back_to_rows(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError
            return [len(t) % 2 for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "ab")], "k long, t string").coalesce(1)
    assert values(annotate.inferred(df, ["k"], "t", load), "k", "prediction") == sorted([(1, 1), (2, None), (3, None), (4, 0)], key=repr)
    assert annotate.inferred(df.limit(0), ["k"], "t", load).count() == 0


def test_blocks(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = lambda x: t0 + dt.timedelta(hours=x)
    df = spark.createDataFrame([(1, h(0)), (1, h(6)), (1, h(12) + dt.timedelta(seconds=1)), (1, h(13)), (1, None)], "k int, ts timestamp")
    assert values(provenance.activity_blocks(df, "k", "ts"), "block", "n", "hours") == [(0, 2, 6.0), (1, 2, 1.0)]
    assert provenance.densest_blocks(df, "k", "ts").first()["block"] == 0


def test_record_epochs(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5 + 5e-7), (1, 3, 0.6), (1, 4, None), (1, 5, 0.6)], "k int, e int, s double")
    assert tuple(provenance.record_epochs(df, "k", "e", "s").first()) == (1, [1, 3], 0.6)


def test_split_sizes(spark):
    for pos, neg in [(0, 10), (1, 0), (1, 9), (50, 7), (3, 500)]:
        df = spark.createDataFrame([("g", i, int(i < pos)) for i in range(pos + neg)], "g string, k long, label int")
        got = {(r["label"], r["part"]): r["count"] for r in sampling.split_by_class(df, ["g"], "label", "k").groupBy("label", "part").count().collect()}
        up = lambda x: -int(-round(x, 9) // 1)
        vp = min(max(up(0.1 * pos), up(0.2 * pos)), pos)
        assert got.get((1, "validation"), 0) == vp and got.get((0, "validation"), 0) == min(max(up(0.1 * neg), up(0.2 * (pos + neg)) - vp), neg)


def test_quotas():
    assert sampling.language_quotas({"EN": 100, "FR": 10}, 60) == {"EN": 50, "FR": 10}
    assert sampling.language_quotas({"EN": 5, "FR": 5}, 60) == {"EN": 5, "FR": 5} and sampling.language_quotas({}, 5) == {}


def test_constrained_sample(spark):
    df = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 50 == 0)) for i in range(1000)], "k long, common int, rare int")
    got = sampling.constrained_sample(df, ["k"], ["common", "rare"], 200, floor=15, ceiling=0.6).collect()
    assert sum(r["rare"] for r in got) >= 15 and len({r["k"] for r in got}) == len(got)
    assert sampling.constrained_sample(df.limit(0), ["k"], ["common", "rare"], 20).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, None])], "k long, v array<double>")
    assert values(vectors.top_k(df, df.filter("k = 1"), "k", "v", 2, 2), "key", "rank") == [(2, 1), (3, 2)]
    assert values(vectors.within(df, df, "k", "v", 2, 0.9), "query", "key") == [(1, 2), (2, 1)]
    assert vectors.top_k(df.limit(0), df, "k", "v", 2, 2).count() == 0
    assert vectors.norms(df.filter("k = 2"), "v").first()["norm"] == 2.0


def test_normalized(spark):
    cat = spark.createDataFrame([(1, "eco", "Eco Frame")], "number int, code string, category string")
    names = spark.createDataFrame([("eco",), ("Eco Frame",), ("Eco_Frame",), ("m/eco_EN.jsonl.model",), ("zzz",), (None,)], "n string")
    assert [r[0] for r in joins.normalized(names, "n", cat).orderBy("raw").collect()].count(None) == 1
    assert sorted(r["number"] for r in joins.normalized(names, "n", cat).collect()) == [1, 1, 1, 1, 99, 99]


def test_metric_cells_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None)], "first int, second int")
    assert tuple(df.agg(*metrics.cells("first", "second")).first()) == (1, 0, 0, 0)


def test_spans_and_merging(spark):
    df = spark.createDataFrame([(1, "Ann  Lee, of Old-Town; x Bob"), (2, ""), (3, None), (4, "no capital"), (5, "Ab1Cd -- --- Ef")], "k int, t string")
    out = {r["k"]: r["s"] for r in df.select("k", "t", T.spans_of("t", "[A-Z][a-z]+").alias("o")).select("k", T.merged_spans("t", "o").alias("s")).collect()}
    assert out == {1: ["Ann  Lee", "Old-Town", "Bob"], 2: [], 3: None, 4: [], 5: ["Ab", "Cd", "Ef"]}


def test_adjusted_keeps_floor_ceiling_and_quota():
    import numpy as np

    r = np.random.default_rng(4)
    labels = np.stack([r.random(400) < p for p in (0.7, 0.2, 0.02)], 1).astype(int)
    kept = sampling.adjusted(labels, 100, 100, 5, 0.5)
    n = labels[kept].sum(0)
    assert 40 <= kept.sum() <= 100 and (n >= 5).all() and n[0] <= 0.5 * kept.sum() + 5
    assert sampling.adjusted(labels[:0], 0, 10, 5, 0.5).sum() == 0
    assert sampling.upscaled(600, 65, 40) == 1300 and sampling.upscaled(6000, 65, 40) == 6000


def test_unmapped_labels_abort(spark):
    categories = spark.createDataFrame([(1, "a", "A b"), (2, "c", "C")], "number int, code string, category string")
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("x", 1, 1)], "code string, first int, second int").withColumn("seq", F.lit(1))
    assert {r["raw"]: r["readable"] for r in joins.readable(pairs.selectExpr("code as n"), "n", categories).collect()} == {"a": "A b", "x": "x"}
    cells = agreement.phase_cells(pairs, "seq", 1)
    with pytest.raises(Exception, match="no category for label x"):
        agreement.per_category(cells, categories, ["cohens_kappa"]).collect()
    good = agreement.per_category(cells.filter("code = 'a'"), categories, ["percent_agreement"]).orderBy("number").collect()
    assert [tuple(r) for r in good] == [(1, "a", 0.5, 0.5, None), (2, "c", None, None, None)]
    with pytest.raises(Exception, match="no category"):
        joins.normalized(pairs.selectExpr("code as n"), "n", categories, strict=True).collect()


def test_pivot_stops_on_duplicates(spark):
    df = spark.createDataFrame([("a", "EN", 1.0), ("a", "FR", 2.0), ("b", "EN", 3.0)], "k string, c string, v double")
    assert values(rollup.pivoted(df, "k", "c", ["EN", "FR"], "v"), "k", "EN", "FR") == [("a", 1.0, 2.0), ("b", 3.0, None)]
    with pytest.raises(Exception, match="more than one row"):
        rollup.pivoted(df.union(df.limit(1)), "k", "c", ["EN", "FR"], "v").collect()


def test_near_texts(spark):
    base = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(1, base), (2, base.replace("w199", "z")), (3, base), (4, base.replace("w50 ", "a b c d e f g h i j ")), (5, None), (6, " "), (7, "too short")], "k int, t string")
    assert [tuple(r)[:2] for r in rows.near_texts(df, "k", "t").collect()] == [(1, 2)]
    assert rows.near_texts(df.limit(0), "k", "t").count() == 0


def test_class_scores(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 1000.0]), (3, None)], "k int, s array<double>").select("k", metrics.softmax("s").alias("p"))
    assert values(df.select("k", metrics.argmax("p").alias("c"), F.get("p", 1).alias("q")), "k", "c", "q") == [(1, 0, 0.5), (2, 1, 1.0), (3, None, None)]


def test_blinding_and_unlabelled(spark):
    df = spark.createDataFrame([(1, ["x"], None, "t", 1, "EN"), (2, ["y"], 1, "t", 1, "EN"), (3, [], None, None, 1, "EN"), (4, [], None, "t", 0, "FR")], "k int, label array<string>, a int, t string, p int, language string")
    assert all(r["label"] == [] for r in annotate.blinded(df).collect()) and annotate.blinded(df.drop("label")).columns == df.drop("label").columns
    assert values(annotate.unlabelled(df, "a", "t"), "k") == [(1,), (4,)] and values(annotate.unlabelled(df, "a", "t", "p", "EN"), "k") == [(1,)]
    assert values(annotate.unlabelled(df, "a", "t", limit=1, order=["k"]), "k") == [(1,)]


def test_vector_index(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    x = np.concatenate([c + 0.4 * r.standard_normal((60, 12)) for c in r.standard_normal((12, 12))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [0.0] * 12), (None, x[0].tolist())], "k long, v array<double>").repartition(3)
    monkeypatch.setattr(vectors, "PIECE", 20)
    centres = vectors.fitted_cells(df, "k", "v", 12)
    index = vectors.indexed(df, "k", "v", 12, centres)
    queries = df.filter("k % 10 = 0")
    assert index.count() == len(x) and 1 < len(centres) <= 27
    best = lambda t: {(r["query"], r["key"]) for r in t.collect()}
    exact = best(vectors.top_k(df, queries, "k", "v", 12, 5))
    assert best(vectors.index_top_k(index, centres, queries, "k", "v", 12, 5, len(centres))) == exact
    assert len(best(vectors.index_top_k(index, centres, queries, "k", "v", 12, 5, 6)) & exact) >= 0.9 * len(exact)
    nothing = vectors.fitted_cells(df.limit(0), "k", "v", 12)
    assert vectors.index_top_k(vectors.indexed(df.limit(0), "k", "v", 12, nothing), nothing, queries.limit(0), "k", "v", 12, 5, 3).count() == 0
