import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bough.llm import line_dedup
from bough.llm.cuckoo import CuckooFilter


def expected(rows, least=10):
    seen, out = set(), {}
    for i, text in sorted(rows):
        kept, gone = [], 0
        for line in text.split("\n"):
            said = line.strip(" ")
            if len(said) >= least and said in seen:
                gone += 1
                continue
            if len(said) >= least:
                seen.add(said)
            kept.append(line)
        out[i] = ("\n".join(kept), gone)
    return out


def corpus(n=60, seed=1):
    dice = random.Random(seed)
    return [(i, "\n".join(dice.choice(["  ", ""]) + f"this is line {dice.randrange(80)}" for _ in range(dice.randrange(1, 9)))) for i in range(n)]


def test_against_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected(rows)


def test_filter():
    dice = np.random.default_rng(1)
    key = dice.integers(0, 1 << 62, (20000, 2))
    f = CuckooFilter.build(key[:10000, 0], key[:10000, 1])
    assert f.contains(key[:10000, 0], key[:10000, 1]).all() and f.contains(key[10000:, 0], key[10000:, 1]).mean() < 0.005
    f.delete(key[:5000, 0], key[:5000, 1])
    assert f.contains(key[5000:10000, 0], key[5000:10000, 1]).all() and f.contains(key[:5000, 0], key[:5000, 1]).mean() < 0.005
    f.delete(key[5000:10000, 0], key[5000:10000, 1])
    assert not f.table.any()


def state(store):
    return sorted(map(tuple, store.counts().collect()))


def test_insert_and_delete_are_reversible(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = line_dedup.LineStore(spark, str(tmp_path / "whole"), shards=4)
    whole.insert(df)
    steps = line_dedup.LineStore(spark, str(tmp_path / "steps"), shards=4)
    steps.insert(df.where("doc_id % 3 = 0"))
    first = state(steps)
    steps.insert(df.where("doc_id % 3 = 1"))
    steps.insert(df.where("doc_id % 3 = 2"))
    assert state(steps) == state(whole)
    steps.delete(df.where("doc_id % 3 <> 0"))
    assert state(steps) == first
    held = {(r["shard"], r["hi"], r["lo"]) for r in steps.counts().collect()}
    for shard, f in steps.filters():
        mine = np.array([[h, lo] for s, h, lo in held if s == shard]).reshape(-1, 2)
        assert f.contains(mine[:, 0], mine[:, 1]).all() and np.count_nonzero(f.table) == len(mine)
    steps.insert(df.where("doc_id % 3 <> 0"))
    assert state(steps) == state(whole)
    with pytest.raises(Exception, match="holds such a document"):
        steps.insert(df.limit(1))
    steps.vacuum()
    assert state(steps) == state(whole)


def test_a_change_rewrites_the_shards_it_touches(spark, tmp_path):
    store = line_dedup.LineStore(spark, str(tmp_path / "store"), shards=64)
    store.insert(spark.createDataFrame(corpus(200), "doc_id long, text string"))
    store.insert(spark.createDataFrame([(1000, "one new line of text\nthis is line 3")], "doc_id long, text string"))
    assert sorted(store._at.values()).count(2) <= 2 and len(store._at) == 64
    store.delete(spark.createDataFrame([(1000,)], "doc_id long"))
    whole = line_dedup.LineStore(spark, str(tmp_path / "whole"), shards=64)
    whole.insert(spark.createDataFrame(corpus(200), "doc_id long, text string"))
    assert state(store) == state(whole)


def test_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "shared line number one"), (4, "shared line number one"), (4, "a unique line of text"), (4, "a unique line of text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup(docs).collect()) == [(1, rows[0][1]), (4, rows[2][1]), (4, rows[2][1])]
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.report(docs).collect()) == [(1, rows[0][1], 0), (4, "", 1), (4, rows[2][1], 0), (4, rows[2][1], 0)]


def test_odd_rows(odd, none):
    got = line_dedup.report(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and by[3][0]["n_removed"] == 0 and by[5][0]["n_removed"] == 1 and by[9][0]["n_removed"] == 1
    assert all(r["n_removed"] == 0 for r in by[None])
    assert line_dedup.report(none).count() == 0 and line_dedup.dedup(none).count() == 0
    kept = line_dedup.dedup(odd)
    assert kept.columns == odd.columns and {r[0] for r in kept.where("row <> 'r' or n_chars <> length(text)").collect()} <= {1}
    assert kept.where("doc_id = 5").count() == 0 and kept.where(F.col("doc_id").isNull()).count() == 2


def test_stage_takes_out_short_lines(spark):
    rows = [(1, "Les.\r\n\r\na line that is long\r\n\r\nend"), (2, "a line that is long\r\n\r\nLes.\r"), (3, "ab\ncd\n\n"), (4, "cd\nab"), (5, "cd\nnew\n \nend")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 3: rows[2][1], 5: "new\n "}
