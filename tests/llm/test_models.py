"""Language identification, LM scores, PII."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bough.llm import language_id, lm_score, pii, quality_rules


def test_gradients_against_differences():
    p = {k: v.astype(np.float64) for k, v in language_id.start(3, 4).items()}
    x = np.random.default_rng(1).integers(97, 105, (7, 5))
    label = np.array([0, 1, 2, 1, 0])
    _, g = language_id.gradients({k: v.astype(np.float32) for k, v in p.items()}, x, label)
    for k, at in (("uf", (1, 2)), ("ub", (3, 11)), ("wf", (2, 1)), ("xf", (99, 5)), ("xb", (100, 9)), ("c", (2,))):
        step = 1e-2
        ends = []
        for s in (step, -step):
            q = {n: v.astype(np.float32).copy() for n, v in p.items()}
            q[k][at] += s
            ends.append(language_id.gradients(q, x, label)[0])
        assert abs((ends[0] - ends[1]) / (2 * step) - g[k][at]) < 2e-3, k


def _tongue(dice, lang):
    syllables = {"aa": ["ka", "ra", "ta", "na"], "bb": ["ölü", "çe", "şi", "ğı"], "cc": ["the", "ing", "shr", "wh"]}[lang]
    return " ".join("".join(dice.choice(syllables) for _ in range(3)) for _ in range(60))


def test_languages_held_out(spark):
    dice = random.Random(3)
    rows = [(i, _tongue(dice, lang), lang if i < 60 else None) for i, lang in enumerate(dice.choice(["aa", "bb", "cc"]) for _ in range(120))]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60).collect()}
    guess = lambda t: "bb" if "ç" in t or "ö" in t or "ş" in t or "ğ" in t else "cc" if "th" in t or "ing" in t or "wh" in t or "shr" in t else "aa"
    assert np.mean([got[i]["language"] == guess(t) for i, t, _ in rows[60:]]) > 0.97
    assert all(sum(got[i]["positions"].values()) == len(t.encode()) for i, t, _ in rows)


def test_pooling_against_single_windows():
    p = language_id.start(3)
    texts = ["a" * 5, "", "hello wörld " * 30, "x"]
    total, labelled = language_id.pooled(p, pa.array(texts))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        want = np.zeros(3)
        for a in range(0, len(raw), language_id.WINDOW):
            want += language_id.positions(p, raw[a : a + language_id.WINDOW][:, None], None).sum(axis=(0, 1))
        assert np.allclose(total[i], want, atol=1e-3) and labelled[i].sum() == len(raw)


def test_languages_of_odd_rows(odd, none):
    got = language_id.identify(odd, steps=3).collect()
    assert len(got) == odd.count() and all((r["language"] is None) == (r["doc_id"] in (1, 2) or r["probability"] is None) for r in got)
    assert language_id.identify(none).count() == 0
    assert {r["language"] for r in language_id.identify(odd.where("lang is null")).collect()} == {None}


def slow_phrases(others, tokens, ladder):
    """Greedy longest matches of the ladder's lengths, by looking for every run in every other text."""
    runs = {tuple(r[i : i + n]) for r in others for n in ladder for i in range(len(r) - n + 1)}
    at = phrases = 0
    while at < len(tokens):
        at += max([1, *(n for n in ladder if at + n <= len(tokens) and tuple(tokens[at : at + n]) in runs)])
        phrases += 1
    return phrases


LADDER = [n for k in range(7) for n in lm_score.lengths(k)]


def test_ladder():
    assert LADDER == [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512]
    assert lm_score.own_phrases([1, 1, 1, 1]) == 3 and lm_score.own_phrases([1, 2, 3]) == 3 and lm_score.own_phrases([]) == 0
    key = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    for part in (key, key[:1], np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert (lm_score.decoded(lm_score.encoded(part)) == part).all()


def test_scores_against_brute_force(spark):
    """Every document against all others, in one batch and in many: short words, copies with changes, copies, texts of one token."""
    dice = random.Random(4)
    say = lambda n: " ".join("abcd"[dice.randrange(4)] + str(dice.randrange(3)) for _ in range(n))
    texts = [say(dice.randrange(1, 40)) for _ in range(40)] + ["nowhere", "nothing alike here"]
    long = say(300).split()
    for at in (50, 170, 290):
        texts.append(" ".join(long[:at] + ["new%d" % at] + long[at:]))
    texts += texts[:5] + [texts[7] + " " + texts[3]] * 2 + [None, "", "?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [(t or "").split() for t in texts]
    whole = sum(len(x) for x in {t: x for t, x in zip(texts, split, strict=True)}.values())
    for size in (700, 1 << 20):
        got = {r["doc_id"]: r for r in lm_score.score(docs, batch=size).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            x = split[i]
            c = 1 if x and texts.count(t) > 1 else slow_phrases([y for u, y in zip(texts, split, strict=True) if u != t], x, LADDER)
            assert (got[i]["tokens"], got[i]["phrases"]) == (len(x), c), (i, t)
            if x:
                bits = c * math.log2(max(whole - len(x), 1))
                k = lm_score.own_phrases(x)
                assert math.isclose(got[i]["cross_entropy"], bits / len(x)) and math.isclose(got[i]["relative_entropy"], (bits - k * math.log2(k)) / len(x), abs_tol=1e-12)
            else:
                assert got[i]["cross_entropy"] is None and got[i]["relative_entropy"] is None


def test_phrases_are_the_longest_matches(spark):
    """Of every length, not only the ladder's: copies with changes, runs of 5, 7, 9, ... tokens that another text has, by brute force over all lengths."""
    dice = random.Random(6)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    base = new(900)
    split = [base, base[:431] + new(1) + base[432:], base[77:640] + new(3)]
    split += [new(2) + base[at : at + n] + new(2) + base[at + 3 : at + 3 + n] for n, at in ((5, 3), (7, 40), (9, 90), (11, 140), (13, 700), (47, 300), (95, 500), (200, 650))]
    split += [[f"v{dice.randrange(3)}" for _ in range(dice.randrange(1, 60))] for _ in range(40)]
    texts = [" ".join(x) for x in split]
    assert len(set(texts)) == len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = [f" {t} " for t in texts]

    def slow(i):
        at = phrases = 0
        while at < len(split[i]):
            n = 1
            while at + n < len(split[i]) and any(" " + " ".join(split[i][at : at + n + 1]) + " " in u for j, u in enumerate(marked) if j != i):
                n += 1
            at, phrases = at + n, phrases + 1
        return phrases

    truth = {i: slow(i) for i in range(len(texts))}
    for size in (2000, 1 << 20):
        assert {r["doc_id"]: r["phrases"] for r in lm_score.score(docs, batch=size, exact=True).collect()} == truth


def test_groups_of_hashes():
    """Ascending, equal ones as they come, also where hashes differ in their low bits alone; runs of several texts by the first and last of a group."""
    dice = np.random.default_rng(8)
    for key in (dice.integers(0, 1 << 64, 5000, np.uint64, False), dice.integers(0, 50, 5000).astype(np.uint64), np.uint64(1 << 63) + dice.integers(0, 9, 5000).astype(np.uint64), np.append(dice.integers(0, 9, 5000).astype(np.uint64), np.uint64((1 << 64) - 1)), np.full(7, (1 << 64) - 1, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        runs, first, order, group = lm_score._grouped(key)
        assert (order == np.argsort(key, kind="stable")).all() and (runs[group] == key[order]).all()
        assert (runs == np.unique(key)).all() and (first == np.unique(key[order], return_index=True)[1]).all()
        text = np.sort(dice.integers(0, 40, len(key)))
        assert (lm_score._several(text, np.arange(len(key)), order, first) == lm_score._differ(text[order], first)).all()
        packed = lm_score._coded(key)
        assert (packed["words"][lm_score._codes(packed)] == key).all()


def test_texts_are_tokenized_once(tmp_path, monkeypatch):
    """Rounds and scores read a batch's tokens, not its texts."""
    texts = ["a b, c a b", "", "a b, d", "!?"]
    group = pa.table({"batch": pa.array([0] * 4, pa.int32()), "h1": [5, 6, 7, 8], "h2": [1, 2, 3, 4], "text": texts})
    (tmp_path / "batch=0").mkdir()
    pq.write_table(lm_score._tokenized(group).drop_columns("batch"), tmp_path / "batch=0" / "x.parquet")
    row, h = lm_score.T.words(pa.array(texts), classes=lm_score.T.TOKENS)
    monkeypatch.setattr(lm_score.T, "words", None)
    state = lm_score._state(str(tmp_path), [], 0)
    assert (state.h == h).all() and (state.text == row).all()
    assert lm_score._asked(str(tmp_path), [], 1, 0).num_rows == 2
    got = lm_score._scores(str(tmp_path), [], [], 0).to_pylist()
    assert [(r["h1"], r["h2"], r["tokens"], r["phrases"], r["own"]) for r in got] == [(5, 1, 6, 6, 5), (6, 2, 0, 0, 0), (7, 3, 4, 4, 4), (8, 4, 1, 1, 1)]


def test_scores_tell_text_from_noise(spark):
    dice = random.Random(2)
    sentences = ["the old man went to the sea", "a dog ran over the green hill", "rain fell on the quiet town"]
    rows = [(i, " ".join(dice.choice(sentences) for _ in range(20))) for i in range(80)] + [(100 + i, " ".join(dice.choice(sentences[0].split() + ["zz%d" % dice.randrange(999)]) for _ in range(140))) for i in range(20)]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 100 and max(got[i]["cross_entropy"] for i in range(80)) < min(got[100 + i]["cross_entropy"] for i in range(20))


def test_scores_of_odd_rows(spark, odd, none):
    got = lm_score.score(odd).collect()
    assert len(got) == odd.count() and all((r["cross_entropy"] is None) == (r["tokens"] == 0) for r in got)
    assert [r["phrases"] for r in got if r["doc_id"] == 5] == [1] and lm_score.score(none).count() == 0


@pytest.mark.parametrize(("text", "good"), [("4111111111111111", True), ("4111111111111112", False), ("0", True)])
def test_luhn(text, good):
    assert pii.luhn(text) is good


def test_pii(spark, odd, none):
    dice = random.Random(7)
    rows, want = [], set()
    for i in range(300):
        words = [f"word{chr(97 + dice.randrange(26))}" for _ in range(30)]
        kind = dice.choice(["email", "phone", "ip", "secret", "card", "date", "none", "none"])
        made = {"email": f"jo{i}@mail.example.com", "phone": f"+1 (555) {dice.randrange(100, 999)}-{dice.randrange(1000, 9999)}", "ip": ".".join(str(dice.randrange(1, 223)) for _ in range(4)), "secret": "".join(dice.choice("0123456789abcdef") for _ in range(40)), "card": "4111 1111 1111 1111", "date": f"20{dice.randrange(10, 20)}-0{dice.randrange(1, 9)}-1{dice.randrange(9)}", "none": "plain"}[kind]
        if kind == "secret" and (made.isdigit() or made.isalpha()):
            made = "a1" + made[2:]
        words[15] = made
        rows.append((i, " ".join(words)))
        if kind not in ("date", "none"):
            want.add((i, made, kind))
    got = {(r["doc_id"], r["value"], r["kind"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert pii.find(none).count() == 0 and pii.find(odd).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("login password=correcthorsebatterystaple end", [("correcthorsebatterystaple", "assigned")]),
        ('api_key: "abcdefgh" and TOKEN = qwertyuiop', [("abcdefgh", "assigned"), ("qwertyuiop", "assigned")]),
        ("host 2001:db8::1 and fe80:0:0:0:1:2:3:4, ::1 too", [("2001:db8::1", "ip6"), ("fe80:0:0:0:1:2:3:4", "ip6"), ("::1", "ip6")]),
        ("at 12:30 or 12:30:45 a:b", [("12:30:45", "ip6")]),
        ("my name is Mary J. Miller. Jürgen went, Anna Schmidt-Weber too", [("Mary J. Miller", "name"), ("Anna Schmidt-Weber", "name")]),
    ],
)
def test_candidates_of_other_kinds(text, want):
    assert [(text[a:b], kind) for a, b, kind in pii.spans(text) if kind != "number"] == want


def test_names_and_keys_are_reported(spark):
    dice = random.Random(5)
    plain = [(i, f"words here mail jo{i}@mail.example.com or call +1 (555) {dice.randrange(100, 999)}-{dice.randrange(1000, 9999)} at 12:30:45 now") for i in range(60)]
    others = [(100 + i, f"the password={''.join(dice.choice('abcdefghijklmnop') for _ in range(16))} and her name is Mary Miller on 2001:db8:{i + 1:x}::{i + 7:x} ok") for i in range(30)]
    got = {(r["doc_id"], r["kind"]) for r in pii.find(spark.createDataFrame(plain + others, "doc_id long, text string")).collect()}
    assert got == {(i, k) for i in range(60) for k in ("email", "phone")} | {(100 + i, k) for i in range(30) for k in ("secret", "name", "ip")}


@pytest.mark.parametrize("text", ["é" * 1_000_000 + "1", "漢字" * 500_000 + "@", "a" * 1_000_000, "1 " * 300_000, "a:" * 400_000, "@" * 500_000, "Mary " * 200_000, "pass" * 250_000, "1.2" * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 12


def test_report_against_brute_force(spark):
    """The votes' patterns weighed by hand: estimates over the list of all spans, one by one, and the classifier over single spans."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spans = [(r["doc_id"], pii.candidate(*x, r["text"])) for r in docs.collect() if r["text"] for x in pii.spans(r["text"])]
    votes = np.array([x[4] for _, x in spans])
    table, share = quality_rules.expectation_maximisation(votes, np.ones(len(votes)), start=(0.7, 0.1), share=0.7)
    odds = np.array([math.log(share / (1 - share)) + sum(math.log(table[1, k] / table[0, k]) if v < 0 else math.log((1 - table[1, k]) / (1 - table[0, k])) if v > 0 else 0 for k, v in enumerate(row)) for row in votes])
    w = pii.regression(np.array([x[5] for _, x in spans]), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), np.ones(len(spans)))
    at = np.concatenate([[0], np.cumsum(pii._SIZES)[:-1]])
    want = {(i, a, b, kind) for i, (a, b, kind, _, _, f) in spans if w[-1] + sum(w[o + v] for o, v in zip(at, f, strict=True)) >= 0}
    assert {(r["doc_id"], r["start"], r["end"], r["kind"]) for r in pii.find(docs).collect()} == want and len(want) > 5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("card 4111111111111111 42 apples", ["4111111111111111"]),
        ("12 4111111111111111", ["4111111111111111"]),
        ("7 4111 1111 1111 1111 42", ["4111 1111 1111 1111"]),
        ("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
        ("call +1 (136) 555-7479. 24 hours", ["+1 (136) 555-7479"]),
        ("555-123-4567 555-765-4321", ["555-123-4567", "555-765-4321"]),
        ("555-123-4567 555-765-4321 4111111111111111 (555) 222-3333", ["555-123-4567", "555-765-4321", "4111111111111111", "(555) 222-3333"]),
        ("12 10.20.30.40 and 555-123-4567 99bob@mail.com", ["10.20.30.40", "555-123-4567", "99bob@mail.com"]),
        ("rate 0.4111111111111111 12", ["0.4111111111111111 12"]),
        ("978-3-16-148410-0", ["978-3-16-148410-0"]),
    ],
)
def test_numbers_next_to_numbers(text, want):
    assert [text[a:b] for a, b, _ in pii.spans(text)] == want


def test_numbers_next_to_numbers_are_reported(spark):
    dice = random.Random(9)
    plain = [(i, f"words here call +1 (555) {dice.randrange(100, 999)}-{dice.randrange(1000, 9999)} or pay card 4111 1111 1111 1111 now") for i in range(60)]
    beside = [(100, "words card 4111111111111111 42 apples"), (101, "then call +1 (136) 555-7479. 24 hours"), (102, "tel +1 (555) 123-4567 +1 (555) 765-4321 both")]
    got = {(r["doc_id"], r["value"]) for r in pii.find(spark.createDataFrame(plain + beside, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert got == {(100, "4111111111111111"), (101, "+1 (136) 555-7479"), (102, "+1 (555) 123-4567"), (102, "+1 (555) 765-4321")}
