"""Packing against its constraints, personal information on held-out sentences."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing, pii
from corpusloom.llm import pii_labels as table


@pytest.mark.parametrize("capacity, sizes", [
    (10, []), (10, [10]), (10, [3] * 7), (10, [6, 4, 6, 4, 5, 5, 5]), (10, [9, 8, 7, 1, 1, 1, 2, 2, 3]), (7, [7, 6, 5, 4, 3, 2, 1] * 5), (1, [1, 1, 1]),
])
def test_plan_keeps_all_items(capacity, sizes):
    plan = packing.packing_plan(Counter(sizes), capacity)
    assert all(sum(c) <= capacity and n > 0 for c, n in plan)
    back = Counter()
    for content, n in plan:
        for s in content:
            back[s] += n
    assert back == Counter(sizes)


def fewest(sizes, capacity):
    """Optimal number of containers by exhaustive search."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in sorted(range(len(rooms)), key=lambda i: rooms[i]):
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_reduction_loses_nothing():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.randint(6, 30)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        stock = packing.Stock(Counter(sizes))
        fixed = packing.reduced(stock, capacity)
        rest = sorted(Counter(stock.count).elements(), reverse=True)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_best_fit_as_item_by_item():
    for seed in range(300):
        r = random.Random(seed)
        capacity = r.randint(5, 60)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 80))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(capacity - s)
        plan = packing.best_fit(packing.Stock(Counter(sizes)), capacity)
        assert sorted(capacity - sum(c) for c, n in plan for _ in range(n)) == sorted(rooms)


def test_packed_items(spark):
    r = random.Random(3)
    sizes = [max(1, int(r.lognormvariate(3, 1))) for _ in range(3000)] + [0, -1, None, 250, 1000, 100, 100]
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, size long").withColumn("rank", F.lit("clash")).withColumn("order", F.lit(1))
    got = packing.packed_items(items, 100).collect()
    per = Counter()
    pieces = Counter()
    for x in got:
        per[x["sequence_id"]] += x["size"]
        pieces[x["key"]] += x["size"]
        assert x["piece"] == 0 or sizes[x["key"]] > 100
    assert max(per.values()) <= 100 and pieces == Counter({k: s for k, s in enumerate(sizes) if s and s > 0})
    assert len({(x["sequence_id"], x["position"]) for x in got}) == len(got)
    assert 1 - sum(per.values()) / (100 * len(per)) < 0.01 and set(per) == set(range(len(per)))
    assert packing.packed_items(items.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.packed_items(items, 0)


def test_packed_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 5000), (5, "é" * 50)], "doc_id long, text string")
    got = packing.packed_documents(docs, 512).collect()
    assert {x["doc_id"] for x in got} == {1, 4, 5} and max(x["n_tokens"] for x in got) <= 512


GIVEN = frozenset(g.lower() for g in ["Marek", "Liane", "Otto", "Nadia"])


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.fitted(), GIVEN)


def found(tagger, text):
    (_, hits), = tagger.tag([text])
    return {(k, v) for _, _, k, v in hits}


@pytest.mark.parametrize("text, expected", [
    ('Levies rose," said Nadia Torvezny, a baker. Mills closed.', {("name", "nadia torvezny")}),
    ("Torvezny, Liane lost the barn in the storm.", {("name", "liane torvezny")}),
    ("Tips: info-torvez@mail.ashgate.example. Mills closed.", {("email", "info-torvez@mail.ashgate.example")}),
    ("Contact - otto.torvez(at)post(dot)ashgate(dot)example. Mills closed.", {("email", "otto.torvez@post.ashgate.example")}),
    ("Call +1 (514) 555-0143 to register. Mills closed.", {("phone", "5145550143")}),
    ("The form listed SIN 046 454 286. Mills closed.", {("id", "046454286")}),
    ("The form listed SIN 046 454 287. Mills closed.", set()),
    ("The open house is at Unit 12 - 1380 Ashwood Rd. Mills closed.", {("address", "1380 ashwood rd")}),
    ("La rencontre a lieu au 482, boul. des Tilleuls. Les digues tiennent.", {("address", "482, boul. des tilleuls")}),
    ("Near Ashville Falls, 23 crews of the Coldmark Energy Board left in March 2031.", set()),
    ("", set()),
])
def test_findings(tagger, text, expected):
    assert found(tagger, text) == expected


def test_held_out_sentences(tagger):
    right = total = wrong = 0
    for row in table.labelled_table(pii.pieces, 4, seed=12345):
        text = "".join(p for p, _ in row)
        gold = Counter(label[0] for _, label in row if label in ("Eb", "Pb", "Ab")) + Counter({"N": sum(label == "F" for _, label in row) + sum(label == "R" and p != "," for p, label in row)})
        (_, hits), = tagger.tag([text])
        got = Counter({"email": "E", "phone": "P", "address": "A", "name": "N"}.get(k, k) for _, _, k, _ in hits if k != "id")
        right += sum((gold & got).values())
        total += sum(gold.values())
        wrong += sum((got - gold).values())
    assert right / total > 0.95 and wrong / total < 0.05


def test_tables(spark):
    names = spark.createDataFrame([("Nadia",), (None,)], "given_name string")
    docs = spark.createDataFrame([(1, "Écrivez à Nadia Torvezny.\nAppelez le 514-555-0143."), (1, "x"), (2, None), (3, "  "), (4, "Call 514-555-0143. Call 514-555-0143 to register.")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {tuple(r) for r in pii.findings(docs, names).collect()}
    assert {(1, "phone", "5145550143"), (4, "phone", "5145550143")} <= got and all(r[0] in (1, 4) for r in got)
    masked = {(r["doc_id"], r["n_found"]): r["text"] for r in pii.masked(docs, names).collect()}
    assert len(masked) == 5 and masked[2, 0] == "" and "[PHONE]" in masked[4, 2] and "514" not in masked[4, 2]
    assert pii.findings(docs.limit(0), names).count() == 0 and pii.findings(docs, names.limit(0)).count() >= 2


def test_pieces_cover_the_text():
    for t in ("a  b\tc\n\nd_e-f 1.5 — «x»", "", " \n ", "x" * 1000):
        assert "".join(pii.pieces(t)) == t
