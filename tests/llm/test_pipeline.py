"""The pipeline, stage by stage, and on a small corpus whose outcome is known."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from bough.llm import shared, simhash


def test_stages(spark, tmp_path, odd, none):
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for docs in (none, odd):
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns + ["finish_time"] * (k == 4)
            out.write.parquet(str(tmp_path / f"{docs is none}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{docs is none}{k}"))


def test_known_outcome(spark, tmp_path):
    dice = random.Random(3)
    vocabulary = "the of and to in is that it for was with as on".split() + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    sentence = lambda: " ".join(dice.choice(vocabulary) for _ in range(40)).capitalize() + "."
    text = lambda: "\n".join(sentence() for _ in range(9))
    passage = " ".join(f"item{chr(97 + i)}" for i in range(26)) + " and the answer is a large number of things."
    clean = [(i, text()) for i in range(60)]
    junk = [(100 + i, "$$$ ### 11 22 !!! BUY @@ " * 12) for i in range(8)]
    again = [(200 + i, "\n".join(line[:-1] + " more." for line in clean[i][1].split("\n"))) for i in range(5)]  # every line changed: line dedup leaves them
    leaked = [(300 + i, text() + " " + passage + " " + text()) for i in range(4)]
    rows = clean + junk + again + leaked
    dice.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for _, stage in corpus_pipeline.STAGES:
        now = shared.spill(stage(spark, now, str(tmp_path)))
        ids.append({r[0] for r in now.select("doc_id").collect()})
    assert {i for i, _ in junk} & ids[0] == set() and {i for i, _ in clean} <= ids[0]
    assert not {i for i, _ in again} & ids[2] and {i for i, _ in clean} <= ids[2]
    assert not {i for i, _ in leaked} & ids[3] and {i for i, _ in clean} <= ids[3]
    assert 20 <= len(ids[4]) <= 40
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_near_copies_that_agree_in_no_segment_go(spark, make):
    """Texts whose fingerprints differ in at most 48 bits, but in two or more of every segment: the third stage keeps one of each pair."""
    dice = random.Random(12)
    pairs = []
    while len(pairs) < 20:
        base = [f"b{dice.randrange(10**9)}" for _ in range(150)]
        texts = [" ".join(base)]
        for _ in range(200):
            copy = list(base)
            for k in dice.sample(range(150), 12):
                copy[k] = f"n{dice.randrange(10**9)}"
            texts.append(" ".join(copy))
        half = simhash.halves(simhash.fingerprints(pa.array(texts))[1].view(np.int64))
        bits = np.bitwise_count(simhash.segments(half[1:]) ^ simhash.segments(half[:1]))
        pairs += [(texts[0], texts[1 + i]) for i in np.flatnonzero((bits.sum(axis=1) <= simhash.MOST) & (bits.min(axis=1) >= 2))[:1]]
    docs = make([(2 * i + j, t, "en", "a") for i, pair in enumerate(pairs) for j, t in enumerate(pair)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == list(range(0, 40, 2))
