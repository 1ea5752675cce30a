"""Consistent form, same-looking texts, related records, overlaps, leaks, near copies: against brute force on small fixtures."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, homoglyphs, leakage, neardup, overlap, ranking, splits
from corpusloom.llm.textform import consistent_form, distinct_pairs, hashed_words, words

WORDS = "river town levy growers mapped costly marsh dikes near under the a of crews paid left in cent per salmon wells held".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def edited(r, text, share):
    return " ".join(w if r.random() > share else r.choice(WORDS) for w in text.split())


def pairs_of(text):
    w = words(text)
    return frozenset(zip(w, w[1:]))


def like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("given, form", [
    ("ＡＢ１！", "AB1!"), ("ﬁn ﬂ", "fin fl"), ("été", "été"), ("a​b­c﻿", "abc"), ("a b c d", "a b c d"),
    ("сut Вау", "cut Bay"), ("μετρο", "μετρο"), ("Ѕ​аlt", "Salt"), ("", ""), (None, None), ("Été, 3 «x»", "Été, 3 «x»"),
])
def test_consistent_form(given, form):
    assert consistent_form(given) == form


def test_hashed_words_match_words():
    texts = ["One two, three!", None, "", "été ﬁn x1", "plain ascii 12", "a_b-c"] * 3
    h, start = hashed_words(texts, block=8)
    seen = {}
    for k, t in enumerate(texts):
        w = words(t)
        assert len(w) == start[k + 1] - start[k]
        for a, b in zip(w, h[start[k] : start[k + 1]].tolist(), strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    p, owner = distinct_pairs(["a b a b", "a b"], np.array([0, 0]))
    assert len(p) == 2 and set(owner) == {0}


def test_same_looking(spark):
    data = [(1, "A cut"), (2, "A сut"), (3, "A cut"), (4, "A c​ut"), (5, None), (6, "  "), (7, " "), (1, "A cut"), (8, "a cut"), (9, "mаrкet"), (10, "market"), (11, "кот"), (10, "other")]
    df = spark.createDataFrame(data, "record_id long, text string").withColumn("form", F.lit("x")).withColumn("key", F.lit("y"))
    assert rows(homoglyphs.same_looking_pairs(df, "record_id", "text"), "record_id_a", "record_id_b") == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert homoglyphs.same_looking_pairs(df.limit(0), "record_id", "text").count() == 0
    assert homoglyphs.dominant_script("mаrкet") == "latin" and homoglyphs.guess("μετρα") != "metpa"


def test_components_and_forest(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)] + [(100, k) for k in range(101, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = list(range(200))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = {v for e in edges if None not in e and e[0] != e[1] for v in e}
    assert rows(components.components(df), "node", "component") == sorted((v, root(v)) for v in nodes)
    tree, label = components.spanning_forest(df.withColumn("weight", F.lit(1.0)))
    groups = defaultdict(set)
    for n, c in rows(label, "node", "component"):
        groups[c].add(n)
    expected = defaultdict(set)
    for v in nodes:
        expected[root(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())) and tree.count() == len(nodes) - len(groups)
    assert components.components(df.limit(0)).count() == 0 and components.spanning_forest(df.limit(0).withColumn("weight", F.lit(1.0)))[1].count() == 0


def test_heaviest_forest(spark):
    r = random.Random(4)
    edges = [(a, b, r.randrange(8) / 8) for a in range(12) for b in range(a) if r.random() < 0.5]
    tree, _ = components.spanning_forest(spark.createDataFrame(edges, "a long, b long, weight double"))
    parent = list(range(12))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    best = 0.0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            best += w
    assert abs(tree.agg(F.sum("weight")).first()[0] - best) < 1e-9


def test_ranked(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(7, 0)], "k long, v long").repartition(5)
    got = defaultdict(list)
    for r in ranking.ranked(df, "k", ["v"]).collect():
        got[r["k"]].append((r["rank"], r["v"]))
    assert all([v for _, v in sorted(x)] == sorted(v for _, v in x) and [k for k, _ in sorted(x)] == list(range(len(x))) for x in got.values()) and len(got) == 4


def test_related_and_splits(spark):
    records = spark.createDataFrame([(1, "One."), (2, "Oｎe."), (3, "Two."), (4, "Three."), (5, None), (6, " "), (7, "Four."), (1, "One.")], "record_id long, text string")
    articles = spark.createDataFrame([(10, "One."), (10, "Two."), (10, None), (11, "Three."), (11, "x"), (None, "Four.")], "doc_id long, sentences string")
    assert rows(splits.related_groups(records, articles), "record_id", "group_record_id") == [(1, 1), (2, 1), (3, 1)]
    comp = splits.related_records(records, articles)
    assert rows(comp, "record_id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]
    before = spark.createDataFrame([(1, "test"), (4, "train"), (3, "validation")], "record_id long, split string")
    got = dict(rows(splits.assigned_splits(comp, before=before), "record_id", "split"))
    assert got[1] == got[2] == got[3] == "quarantined" and got[4] == "train" and set(got) == {1, 2, 3, 4, 5, 6, 7}
    kept = dict(rows(splits.assigned_splits(comp, before=before.filter("record_id <> 3")), "record_id", "split"))
    assert kept[1] == kept[2] == kept[3] == "test"
    many = spark.range(3000).select(F.col("id").alias("record_id"), (F.col("id") - F.col("id") % 3).alias("component"))
    share = {r["split"]: r["count"] / 3000 for r in splits.assigned_splits(many).groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert splits.related_groups(records.limit(0), articles).count() == 0 and splits.assigned_splits(comp.limit(0)).count() == 0


def test_earlier_records_count_toward_the_proportions(spark):
    new = spark.range(1000, 2000).select(F.col("id").alias("record_id"), F.col("id").alias("component"))
    before = spark.range(1000).select(F.col("id").alias("record_id"), F.lit("train").alias("split"))
    share = {r["split"]: r["count"] for r in splits.assigned_splits(new, before=before).groupBy("split").count().collect()}
    assert abs(share["train"] - 600) < 20 and abs(share["validation"] - 200) < 20 and abs(share["test"] - 200) < 20


def collection(seed, n=60):
    r = random.Random(seed)
    base = [sentence(r, r.choice([1, 2, 3, 5, 8, 20, 40])) for _ in range(n)]
    out = base + [edited(r, t, r.choice([0, 0.02, 0.05, 0.1, 0.2])) for t in base for _ in range(2)]
    return out + ["", None, "   ", "Ｗord", base[0], base[0]]


def test_overlaps_match_brute_force(spark):
    a, b = collection(1), collection(2)[:40] + collection(1)[30:90]
    ev = spark.createDataFrame([(k, "blind", None if k % 5 else "s", t) for k, t in enumerate(a)], "record_id long, split string, source string, text string").withColumn("name", F.lit("clash"))
    tr = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(b)], "record_id long, text string")
    expected = sorted((i, 1000 + j) for i, x in enumerate(a) for j, y in enumerate(b) if like(pairs_of(x), pairs_of(y)) >= 0.6 - 1e-9)
    assert rows(overlap.overlap_pairs(ev, tr), "record_id", "train_record_id") == expected
    small, e = overlap.cross_split_overlaps(ev, tr, shard=600, texts=500, runs=True)
    pairs = small.filter("key is not null").join(e.withColumnsRenamed({"key": "i", "name": "e"}), "e")
    assert rows(pairs, "i", "key") == expected
    whole, _ = overlap.cross_split_overlaps(ev, tr, runs=True)
    assert rows(overlap.covered(small), "e", "covered") == rows(overlap.covered(whole), "e", "covered")
    report = overlap.overlap_report(ev, tr)
    assert report.agg(F.sum("n_overlapping")).first()[0] == len({i for i, _ in expected}) and report.agg(F.sum("n_records")).first()[0] == len(a)
    assert overlap.overlap_pairs(ev.limit(0), tr).count() == overlap.overlap_pairs(ev, tr.limit(0)).count() == 0


def test_coverage_is_merged_over_training_texts(spark):
    w = [f"w{k}" for k in range(40)]
    ev = spark.createDataFrame([(1, " ".join(w)), (2, "x y z"), (3, None), (4, " ".join(w[:7]))], "record_id long, text string")
    # words 0-11, 8-17 and 30-39 of the first text; seven in a row are no run
    tr = spark.createDataFrame([(10, " ".join(w[:12] + ["a"])), (11, " ".join(["b", *w[8:18]])), (12, " ".join(w[30:])), (13, " ".join(["c", *w[20:27], "d"])), (14, " ".join(w[:12] + ["a"])), (15, "w5")], "record_id long, text string")
    found, ev_keys = overlap.cross_split_overlaps(ev, tr, runs=True)
    got = dict(rows(overlap.covered(found).join(ev_keys.withColumnRenamed("name", "e"), "e"), "key", "covered"))
    assert got == {1: 28}


def test_coverage_matches_brute_force(spark):
    a, b = collection(5), collection(6)[:30] + collection(5)[20:70]
    ev, tr = (spark.createDataFrame([(k, t) for k, t in enumerate(x)], "record_id long, text string") for x in (a, b))
    runs = {tuple(w[i : i + 8]) for w in map(words, b) for i in range(len(w) - 7)}
    expected = {}
    for k, t in enumerate(a):
        w = words(t)
        inside = {i + j for i in range(len(w) - 7) if tuple(w[i : i + 8]) in runs for j in range(8)}
        if inside:
            expected[k] = len(inside)
    found, keys = overlap.cross_split_overlaps(ev, tr, shard=900, runs=True)
    assert dict(rows(overlap.covered(found).join(keys.withColumnRenamed("name", "e"), "e"), "key", "covered")) == expected


def test_leaks_match_brute_force(spark):
    r = random.Random(5)
    items = [sentence(r, n) for n in (5, 12, 13, 30, 700)] + [None, " "]
    docs = [sentence(r, 30) + " " + " ".join(it.split()[a : a + n]) + " " + sentence(r, 3) for it in items if it for a, n in ((0, 11), (0, 12), (1, 12), (3, 40))]
    docs += [items[4], items[4], sentence(r, 2000) + " ".join(items[3].split()[:14]), None, "", "x"]
    d = spark.createDataFrame([(k, t, "s") for k, t in enumerate(docs)], "doc_id long, text string, source string")
    i = spark.createDataFrame([(k, t, "gold") for k, t in enumerate(items)], "item_id long, text string, suite string")
    window = lambda t: {tuple(w[k : k + 12]) for w in [words(t)] for k in range(len(w) - 11)}
    expected = sorted((a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if window(x) & window(y))
    assert rows(leakage.leaks(d, i), "doc_id", "item_id") == expected
    assert rows(leakage.leaks(d, i, block_words=20), "doc_id", "item_id") == expected
    assert leakage.leaks(d.limit(0), i).count() == leakage.leaks(d, i.limit(0)).count() == 0
    assert leakage.leak_report(d, i).agg(F.sum("n_documents")).first()[0] == len(expected)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_copies_match_brute_force(spark, hot):
    t = collection(7)
    df = spark.createDataFrame([(0, k, [x] if x is not None else []) for k, x in enumerate(t)] + [(1, 5, t[3:6]), (1, 6, [t[4], t[3], None, t[5]]), (1, 7, None)], "tab int, key long, texts array<string>")
    sets = {k: pairs_of(x) for k, x in enumerate(t)}
    expected = sorted((0, i, j) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.6 - 1e-9) + [(1, 5, 6)]
    old = neardup.candidate_pairs.__defaults__
    neardup.candidate_pairs.__defaults__ = (old[0], hot, 50)
    try:
        assert rows(neardup.near_copy_pairs(df), "tab", "key_a", "key_b") == expected
    finally:
        neardup.candidate_pairs.__defaults__ = old
    groups = neardup.near_copy_groups(df)
    assert groups.count() == sum(bool(s) for s in sets.values()) + 2 and groups.filter("tab = 1").select("class_key").distinct().count() == 1
    assert neardup.near_copy_pairs(df.limit(0)).count() == 0


def test_bounds_hold():
    r = random.Random(9)
    sets = [frozenset(r.sample(range(1 << 20), r.choice([3, 20, 70, 130, 300]))) for _ in range(40)]
    sets += [frozenset(list(s)[: max(1, int(len(s) * 0.8))]) for s in sets]
    n = np.array([len(s) for s in sets])
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    p = neardup.Points(*neardup.points(flat, np.repeat(np.arange(len(sets)), n), n), n)
    q, x = map(np.array, zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets)) if n[j] <= n[i] and n[j] >= 0.6 * n[i]], strict=True))
    true = np.array([len(sets[a] & sets[b]) for a, b in zip(q, x, strict=True)])
    assert p.bounded(q, x, true).all()


def test_deliveries_extend_the_component_table(spark, tmp_path):
    records = lambda *r: spark.createDataFrame(list(r), "record_id long, text string")
    articles = lambda *a: spark.createDataFrame(list(a), "doc_id long, sentences string")
    one = records((10, "a b c"), (11, "d e f"), (12, "g h i"), (13, None), (14, "zz"), (14, "zz"))
    first = splits.delivered(None, one, articles((1, "d e f"), (1, "later text"), (2, "nobody's text"), (None, "d e f"), (3, None))).saved(str(tmp_path / "1"))
    held = {r["record_id"]: r["split"] for r in first.members.collect()}
    assert set(held) == {10, 11, 12, 13, 14} and None not in held.values()
    # 20 joins 11 over an article of the first delivery, 21 joins 10 and 12 over a new one, 22 stands alone, 12 comes again
    two = records((20, "later text"), (21, "x y"), (22, "own"), (12, "g h i"), (23, None), (5, "a b c"))
    second = splits.delivered(first, two, articles((7, "x y"), (7, "a b c"), (7, "g h i"))).saved(str(tmp_path / "2"))
    got = {r["record_id"]: (r["component"], r["split"]) for r in second.members.collect()}
    assert {k: c for k, (c, _) in got.items()} == {5: 5, 10: 5, 12: 5, 21: 5, 11: 11, 20: 11, 13: 13, 14: 14, 22: 22, 23: 23}
    assert got[20][1] == held[11] and got[13][1] == held[13] and got[14][1] == held[14]
    assert all(got[k][1] == (held[10] if held[10] == held[12] else "quarantined") for k in (5, 10, 12, 21))
    whole = one.union(two)
    both = articles((1, "d e f"), (1, "later text"), (7, "x y"), (7, "a b c"), (7, "g h i"))
    assert rows(splits.related_records(whole, both), "record_id", "component") == sorted((k, c) for k, (c, _) in got.items())
    third = splits.delivered(second, records().limit(0), None)
    assert {r["record_id"]: (r["component"], r["split"]) for r in third.members.collect()} == got


def test_tokens_by_script_and_vocabulary(spark):
    # the second text has a token of look-alikes only that is a word of the corpus, the third one that isn't
    df = spark.createDataFrame([(1, "a cop came"), (2, "a сор came"), (3, "a росс came"), (4, "a cоp came"), (5, "a cop cаme"), (6, None), (7, "")], "record_id long, text string")
    got = dict(rows(homoglyphs.consistent_texts(df, "record_id", "text").filter("key is not null"), "key", "form"))
    assert got == {1: "a cop came", 2: "a cop came", 3: "a росс came", 4: "a cop came", 5: "a cop came", 6: None, 7: ""}
