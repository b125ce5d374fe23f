"""Decontamination and license scans."""

import random

import numpy as np
import pyarrow as pa

from bough.llm import decontamination, licenses
from bough.llm import text as T


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs():
    dice = random.Random(1)
    for _ in range(200):
        a, b = ([dice.randrange(5) for _ in range(dice.randrange(1, 12))] for _ in "ab")
        assert decontamination.lcs(a, b) == slow_lcs(a, b)


def bench_docs(seed=2, n=120):
    dice = random.Random(seed)
    items = [(i, " ".join(f"b{dice.randrange(2000)}" for _ in range(dice.choice([24, 40, 90])))) for i in range(25)]
    rows, planted = [], set()
    for i in range(n):
        words = [f"c{dice.randrange(600)}" for _ in range(dice.randrange(60, 300))]
        if i % 3 == 0:
            k = dice.randrange(25)
            passage = items[k][1].split()
            if i % 2:  # a paraphrase: words exchanged, put in, left out
                passage = [w for j, w in enumerate(passage) if j % 9 != 4]
                passage[3:3] = ["c1"]
            at = dice.randrange(len(words))
            words[at:at] = passage
            planted.add((i, k))
        rows.append((i, " ".join(words)))
    return items, rows, planted


def test_finds_passages_and_nothing_else(spark):
    items, rows, planted = bench_docs()
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == planted
    assert {r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()} == {i for i, _ in rows} - {i for i, _ in planted}


def test_short_items_that_many_documents_quote(spark):
    """An item's words weigh little where many documents hold it; among rare words it is found all the same."""
    for share in (5, 10, 20):
        dice = random.Random(share)
        items = [(0, " ".join(f"s{i}" for i in range(15)))] + [(k, " ".join(f"b{dice.randrange(2000)}" for _ in range(40))) for k in range(1, 20)]
        rows, planted = [], set()
        for i in range(400):
            words = [f"r{dice.randrange(10**6)}" for _ in range(dice.randrange(60, 120))]
            if i % 100 < share:
                at = dice.randrange(len(words))
                words[at:at] = items[0][1].split()
                planted.add((i, 0))
            rows.append((i, " ".join(words)))
        docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()} == planted


def test_svd_against_numpy(spark):
    items, rows, _ = bench_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = decontamination.inverse_frequencies(docs)
    table = decontamination.passages(spark.createDataFrame(items, "item_id long, text string")).cache()
    feature, vectors = decontamination.svd(table, idf, rank=8)
    full = np.zeros((table.count(), 1 << decontamination.BITS))
    for i, r in enumerate(table.collect()):
        f, w = decontamination._weighted(np.array(r["words"], np.int64), idf)
        full[i, f] = w
    exact = np.linalg.svd(full[:, feature], compute_uv=False)
    found = np.linalg.norm(full[:, feature] @ vectors, axis=0)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-3) and (found[:8] ** 2).sum() > 0.9 * (exact[:8] ** 2).sum()
    df = np.zeros(1 << decontamination.BITS)
    for _, t in rows:
        df[np.unique(T.words(pa.array([t]))[1] >> np.uint64(64 - decontamination.BITS))] += 1
    assert np.allclose(idf, np.log((len(rows) + 1) / (df + 1)) + 0.1, atol=1e-4)


def test_odd_benchmarks_and_documents(spark, odd, none):
    b = spark.createDataFrame([(1, None), (None, "some words here"), (2, ""), (3, "?!"), (4, "x y z w v u t s r q p o n m")], "item_id long, text string")
    assert decontamination.contaminated(odd, b).count() == 0
    kept = decontamination.clean(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    for benchmark in (b.limit(0), b):
        assert decontamination.clean(none, benchmark).count() == 0
    assert decontamination.clean(odd, b.limit(0)).count() == odd.count() and decontamination.contaminated(odd, b.limit(0)).count() == 0


def test_windows_meet_with_the_promised_probability():
    """Every template that a document holds, whole or with a word exchanged, is among the candidates."""
    dice = random.Random(8)
    known = licenses.Templates(licenses.TEMPLATES)
    texts, held = [], []
    for _ in range(1500):
        k = dice.randrange(len(known.names))
        words = [f"f{dice.randrange(500)}" for _ in range(dice.randrange(30, 200))]
        at = dice.randrange(len(words))
        words[at:at] = licenses.TEMPLATES[known.names[k]].lower().split()
        texts.append(" ".join(words))
        held.append(k)
    row, h = T.words(pa.array(texts))
    at, g = T.grams(row, h, licenses.SHINGLE)
    pairs = set(known.candidates(row[at], g).tolist())
    assert np.mean([i * len(known.names) + k in pairs for i, k in enumerate(held)]) > 0.998


def test_licenses_against_brute_force(spark, odd, none):
    dice = random.Random(5)
    rows = []
    for i in range(80):
        words = [f"f{dice.randrange(300)}" for _ in range(80)]
        for _ in range(dice.randrange(3)):
            t = dice.choice(list(licenses.TEMPLATES.values())).split()
            if dice.random() < 0.3:
                t = t[: len(t) // 2]
            at = dice.randrange(80)
            words[at:at] = t
        rows.append((i, " ".join(words)))
    shingles = lambda t: {tuple(w[i : i + 3]) for w in [_words(t)] for i in range(len(w) - 2)}
    want = set()
    for i, t in rows:
        own = shingles(t)
        for name, template in licenses.TEMPLATES.items():
            s = shingles(template)
            if len(s & own) / len(s) >= licenses.LEAST:
                want.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 20
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0


def _words(t):
    import re

    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.lower())
