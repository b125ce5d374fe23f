import hashlib
import random
from fractions import Fraction

from bough.llm import mixing


def expected(rows, weights, budget=None, fraction=0.5, seed="mix"):
    n = lambda t: len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ").count("")
    sources = {}
    for i, t, s in rows:
        d = hashlib.md5("|".join([seed, "-" if s is None else f"{len(s)}:{s}", "-" if i is None else str(i), "-" if t is None else "t" + t]).encode()).hexdigest()
        sources.setdefault(s, []).append((d, i, n(t)))
    line = []
    for s, docs in sources.items():
        total = 0
        w = weights.get(s, 1.0)
        for d, i, k in sorted(docs):
            total += k
            if w > 0:
                line.append((Fraction(total) / Fraction(w), s or "", d, i, k))
    line.sort()
    budget = int(sum(n(t) for _, t, _ in rows) * fraction) if budget is None else budget
    out, total = [], 0
    for _, s, _, i, k in line:
        total += k
        if total <= budget:
            out.append((i, s))
    return sorted(out)


def test_against_brute_force(spark):
    dice = random.Random(4)
    rows = [(i, " ".join("x" * dice.randrange(1, 4) for _ in range(dice.randrange(0, 40))), dice.choice(["a", "a", "a", "b", "c"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ({}, {"a": 4.0, "b": 0.5}, {"c": 0.0}):
        got = sorted((r["doc_id"], r["source"]) for r in mixing.queue(df, weights).collect())
        assert got == expected(rows, weights)
    tokens = {s: 0 for s in "abc"}
    for r in mixing.queue(df, {"a": 2.0}, budget=900).collect():
        tokens[r["source"]] += r["tokens"]
    assert abs(tokens["a"] / tokens["b"] - 2) < 0.6 and sum(tokens.values()) <= 900


def test_odd_rows(odd, none):
    whole = mixing.mix(odd, fraction=1.0)
    assert whole.columns == [*odd.columns, "finish_time"] and whole.count() == odd.count()
    assert mixing.mix(none).count() == 0
    assert mixing.mix(whole, fraction=1.0).columns == whole.columns
    times = [r[0] for r in whole.select("finish_time").collect()]
    assert times == sorted(times)
    assert {r["doc_id"] for r in mixing.mix(odd, weights={"b": 0.0, None: 0.0}, fraction=1.0).collect()} == {1, 2, 5, 6, 8}


def test_null_and_empty_sources_are_two(make):
    rows = make([(1, "a b c", "en", None), (1, "a b c", "en", ""), (2, None, "en", ""), (2, "", "en", "")])
    kept = mixing.mix(rows, weights={None: 0.0}, fraction=1.0).collect()
    assert sorted((r["doc_id"], r["source"]) for r in kept) == [(1, ""), (2, ""), (2, "")]
    assert mixing.queue(rows, fraction=1.0).select("digest").distinct().count() == 4
