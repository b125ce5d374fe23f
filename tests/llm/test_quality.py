import random

import numpy as np

from bough.llm import quality_classifier, quality_rules

GOOD = "the cat and the dog went to the old house by the river, and it was a fine day for all of them."


def test_em_finds_accuracies():
    dice = np.random.default_rng(3)
    good = dice.random(60000) < 0.8
    p = np.array([[0.7, 0.6, 0.8, 0.9], [0.1, 0.05, 0.2, 0.15]])  # P(bad vote | class)
    votes = np.where(dice.random((60000, 4)) < p[good.astype(int)], -1, 1) * (dice.random((60000, 4)) < 0.7)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, share = quality_rules.expectation_maximisation(patterns, counts)
    assert abs(share - 0.8) < 0.03 and np.abs(table - p).max() < 0.05


def test_posterior_against_brute_force(spark):
    dice = random.Random(1)
    rows = [(i, dice.choice([GOOD * dice.randrange(1, 5), "!!! $$$ ### " * 20, "BUY NOW " * 30, "x1 9 7 " * 9, GOOD[:30]])) for i in range(200)]
    got = {r["doc_id"]: r for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    votes = np.array([[got[i][n] for n in quality_rules.NAMES] for i in range(200)])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, share = quality_rules.expectation_maximisation(patterns, counts)
    for i in range(200):
        like = [share if c else 1 - share for c in (0, 1)]
        for c in (0, 1):
            for k in range(len(quality_rules.NAMES)):
                like[c] *= {-1: table[c, k], 1: 1 - table[c, k], 0: 1}[votes[i, k]]
        assert abs(like[1] / sum(like) - got[i]["quality"]) < 1e-6
    assert all(got[i]["keep"] for i, t in rows if t.startswith("the cat") and len(t) > 40) and not any(got[i]["keep"] for i, t in rows if t.startswith("!!!"))


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.score(odd).collect()
    assert len(got) == odd.count() and all(r["keep"] is not None for r in got)
    assert {r["doc_id"]: [r[n] for n in quality_rules.NAMES] for r in got}[1] == [0] * len(quality_rules.NAMES)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {1, 2} <= {r["doc_id"] for r in kept.collect()}
    assert quality_rules.score(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def corpus(n, seed):
    dice = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = dice.choice(["good", "junk", "toxic"])
        pool = {"good": 200, "junk": 0, "toxic": 200}[kind]
        words = [f"w{dice.randrange(200)}" if pool else f"!! {dice.randrange(9)} $" for _ in range(40)]
        if kind == "toxic":
            words[dice.randrange(40)] = words[dice.randrange(40)] = "slur"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_classifier_held_out_accuracy(spark):
    rows, labels = corpus(900, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, known).collect()}
    assert np.mean([got[i]["keep"] == bool(q and not t) for i, q, t in labels[600:]]) > 0.97


def test_scores_are_dot_products():
    import pyarrow as pa

    text = pa.array(["a b a", None, ""])
    row, place = quality_classifier.features(text)
    assert row.tolist() == [0] * len(row) and len(place) == len(set(place.tolist())) == 4  # a, b, "a b", "b a"
    model = quality_classifier.Ftrl()
    for _ in range(50):
        model.update(place, 1)
        model.update(place[:1], 0)
    w = model.weights()
    assert w[place].sum() + w[-1] > 0 > w[place[0]] + w[-1]


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(odd, labels).collect()
    assert len(got) == odd.count() and all(r["quality"] is not None for r in got)
    assert {(r["quality"], r["toxic"], r["keep"]) for r in quality_classifier.score(odd, labels.limit(0)).collect()} == {(0.5, 0.5, True)}
    assert quality_classifier.score(none, labels).count() == 0
