import math
import random
import re

import numpy as np

from joinwright.llm.toxicity import SeverityModel, drop_toxic, fit, score_toxicity, select_features, train, features, without_near_copies

CLEAN = "river stone cloud paper table garden window letter summer winter market bridge forest music pencil".split()
BAD = ["grubnak", "zorvexa", "zorvexi", "zorvexum", "snarglet"]


def corpus(seed, n=400):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        words = [draw.choice(CLEAN) + draw.choice(["", "s", "ly", "er"]) for _ in range(draw.randint(20, 80))]
        grade = (1 + (k % 10 == 0)) * (k % 5 == 0)
        for _ in range(grade * draw.randint(2, 4)):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        rows.append((" ".join(words), grade))
    return rows


def test_held_out_accuracy_and_shared_scale():
    model = fit(corpus(1))
    test = corpus(2)
    said = [model.severity(t)[0] >= model.cut for t, _ in test]
    right = np.mean([a == bool(b) for a, (_, b) in zip(said, test)])
    clean_lost = sum(a and not b for a, (_, b) in zip(said, test))
    assert right >= 0.97 and clean_lost == 0
    assert model.thresholds[0] < model.thresholds[1]
    low, high = model.severity("river grubnak stone grubnak")[0], model.severity("grubnak zorvexa snarglet " * 4)[0]
    assert model.severity("river stone")[0] < low < high <= 2
    assert model.severity("grubnak zorvexa snarglet " * 6)[1] == 2 and model.severity("river stone")[1] == 0
    graver = [model.severity(t)[0] for t, y in test if y == 2], [model.severity(t)[0] for t, y in test if y == 1]
    assert np.mean(graver[0]) > np.mean(graver[1])


def brute_severity(model, text):
    """Weights of each feature in turn, found by looking at every word's every beginning."""
    score, words = 0.0, re.findall(r"[^\W\d_]+", text.lower())
    for f, w in model.weights.items():
        n = sum(x.startswith(f[1:]) if f[0] == "^" else x == f for x in words)
        score += w * math.log(1 + n) if n else 0.0
    above = [1.0] + [1 / (1 + math.exp(t - score)) for t in model.thresholds] + [0.0]
    shares = [a - b for a, b in zip(above, above[1:])]
    return sum(above[1:-1]), max(range(len(shares)), key=lambda g: (shares[g], -g))


def test_scores_against_brute_force(spark):
    rows = corpus(6, 300)
    model = fit(rows)
    texts = [t for t, _ in corpus(7, 60)] + [None, "", "É grubnaks 9 ZORVEXA_x", "zorvexa " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score_toxicity(df, model).collect():
        severity, grade = brute_severity(model, texts[r.doc_id] or "")
        assert abs(r.severity - severity) < 1e-9 and r.grade == grade and r.toxic == (r.severity >= model.cut)


def test_two_grades_have_one_threshold():
    model = fit([(t, min(y, 1)) for t, y in corpus(1)])
    assert len(model.thresholds) == 1 and model.severity("grubnak zorvexa " * 4)[0] <= 1
    assert np.mean([(model.severity(t)[0] >= model.cut) == bool(y) for t, y in corpus(2)]) >= 0.97


def test_dropping_keeps_columns_of_any_name(spark):
    model = fit(corpus(1))
    rows = [(1, "grubnak zorvexa snarglet " * 3, "mine", 7.5, 3), (2, "river stone", "mine", 1.5, 4), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, severity double, grade int")
    kept = drop_toxic(docs, model)
    assert kept.schema == docs.schema and sorted(kept.collect(), key=str) == sorted(docs.where("doc_id is null or doc_id = 2").collect(), key=str)


def test_beginnings_stand_for_unseen_words():
    model = fit(corpus(3))
    assert any(f.startswith("^zorv") or f.startswith("^zor") for f in model.weights)
    assert model.severity("the zorvexolino and zorvexity")[0] >= model.cut


def test_no_examples_of_a_class():
    for rows in ([], [("a b", 0)], [("a b", 1), ("c d", 1)]):
        model = fit(rows)
        assert model.severity("anything") == (0.0, 0) and model.cut == float("inf")
    assert SeverityModel().severity("")[0] == 0.0


def test_near_copies_are_left_out():
    text = " ".join(f"w{i}" for i in range(60))
    assert len(without_near_copies([(text, 1), (text + " x", 1), ("quite another text stands here now", 0)])) == 2


def test_selection_needs_toxic_texts_only():
    texts = ["bad word bad"] * 9 + ["good word"] * 9
    chosen = select_features(texts, np.array([1] * 9 + [0] * 9), 2000)
    assert "bad" in chosen and "word" not in chosen
    assert features("Bad")["bad"] == features("bad")["^bad"] == 1


def test_query_rows_columns_and_odd_input(spark):
    rows = corpus(4, 300)
    docs = [(i, t, "clash", i) for i, (t, _) in enumerate(rows)] + [(900, None, None, 1), (901, "", "", 1), (902, "grubnak " * 30_000, "x", 1), (None, rows[0][0], "x", 1), (1, rows[1][0], "x", 1)]
    labels = [(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (5, None), (7, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, severity string, extra int")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")  # noqa: E741
    model = train(d, l)
    found = score_toxicity(d, model).collect()
    assert len(found) == len(docs)
    by = {r.doc_id: r for r in found}
    assert by[902].toxic and not by[900].toxic and not by[901].toxic
    assert np.mean([by[i].toxic == bool(y) for i, (_, y) in enumerate(rows)]) >= 0.97
    empty = train(d.limit(0), l)
    assert score_toxicity(d, empty).where("toxic").count() == 0
    assert train(d, l.limit(0)).thresholds == ()
