import random

import numpy as np
import pyarrow as pa

from bough.llm import simhash


def texts(seed=3, groups=40):
    dice = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}x{dice.randrange(300)}" for _ in range(120)]
        for _ in range(dice.randrange(1, 4)):
            copy = list(base)
            for _ in range(dice.randrange(0, 9)):
                copy[dice.randrange(len(copy))] = f"new{dice.randrange(10**6)}"
            out.append(" ".join(copy))
    dice.shuffle(out)
    return out


def grouped(nodes, edges):
    """The groups that edges make, as the least node of each node's group."""
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows, most):
    longs = np.array([r[1:] for r in rows], np.int64)
    d = np.bitwise_count((longs[:, None, :] ^ longs[None, :, :]).view(np.uint64)).sum(axis=2)
    return {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(d <= most), strict=True) if i != j}


def against(prints):
    """Edges found are near pairs; groups are those of all near pairs up to the bits that the search is complete for, and of nearly all up to MOST."""
    rows = prints.dropDuplicates([f"f{k}" for k in range(5)]).cache()
    got = [tuple(r) for r in simhash.near_edges(rows).collect()]
    here = rows.collect()
    ids = [r[0] for r in here]
    near = brute(here, simhash.MOST)
    assert set(got) <= near
    mine, all_ = grouped(ids, got), grouped(ids, near)
    sure = brute(here, 2 * simhash.SEGMENTS - 1)
    assert all(mine[a] == mine[b] for a, b in sure) and len(sure) > 20
    assert sum(mine[a] == mine[b] for a, b in near) >= 0.99 * len(near)
    assert len(set(mine.values())) <= len(set(all_.values())) + 1


def test_groups_against_brute_force(spark):
    against(simhash.fingerprint_table(spark.createDataFrame(list(enumerate(texts(groups=150))), "doc_id long, text string")))


def test_groups_of_documents_against_brute_force(spark):
    against(simhash.fingerprint_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_more_tasks_give_the_same_groups(spark):
    rows = simhash.fingerprint_table(spark.createDataFrame(list(enumerate(texts(groups=60))), "doc_id long, text string")).dropDuplicates([f"f{k}" for k in range(5)]).cache()
    ids = [r[0] for r in rows.collect()]
    assert grouped(ids, map(tuple, simhash.near_edges(rows, top=1).collect())) == grouped(ids, map(tuple, simhash.near_edges(rows, top=6).collect()))


def test_large_bucket_takes_few_comparisons(monkeypatch):
    """2,000 fingerprints a few bits apart are one group after far fewer than 2,000,000 comparisons."""
    dice = np.random.default_rng(3)
    bits = np.repeat(dice.integers(0, 2, (1, 320)), 2000, axis=0)
    for row in bits:
        row[dice.choice(320, 8, replace=False)] ^= 1
    half = simhash.halves(np.packbits(bits.astype(np.uint8), axis=1).view(np.int64))
    value = simhash.segments(half)[:, 0]
    compared = []
    real = simhash.chained
    monkeypatch.setattr(simhash, "chained", lambda a, b, most: compared.append(len(a)) or real(a, b, most))
    target = value & ((1 << 17) - 1) | (np.bincount(value >> 17).argmax() << 17)
    a, _ = simhash.linked(value, target == value, target, half, 17, simhash.MOST)
    assert sum(compared) < 200_000 and len(a) > 1500


def test_fingerprints_do_not_depend_on_the_batch():
    rows = texts(groups=60)
    whole = simhash.fingerprints(pa.array(rows))[1]
    assert all((simhash.fingerprints(pa.array([t]))[1][0] == whole[i]).all() for i, t in enumerate(rows))


def test_chains_keep_every_near_pair():
    dice = np.random.default_rng(1)
    a = dice.integers(0, 1 << 10, (400, 32)).astype(np.uint16)
    b = a.copy()
    for i in range(400):
        for k in dice.choice(320, dice.integers(0, 100), replace=False):
            b[i, k // 10] ^= 1 << (k % 10)
    d = np.bitwise_count(a ^ b).sum(axis=1)
    assert simhash.chained(a, b).tolist() == np.flatnonzero(d <= simhash.MOST).tolist()


def test_groups_keep_one(spark, make, odd, none):
    dice = random.Random(1)
    base = " ".join(f"q{dice.randrange(10**6)}" for _ in range(200))
    near = base.replace(base.split()[7], "other")
    docs = make([(5, base, "en", "a"), (3, base, "en", "b"), (9, near, "en", "a"), (1, " ".join(f"z{i}" for i in range(200)), "en", "a")])
    assert {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(docs).collect()} == {(5, 3), (9, 3)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    out = simhash.keep_one(odd).collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(None) == 2 and {1, 2, 3, 6} <= set(ids) and ids.count(4) == 1 and 5 not in ids


def test_many_copies_and_order(spark):
    """Hundreds of equal and near texts, in whatever order of rows, end in one group."""
    dice = random.Random(9)
    base = [f"m{dice.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        if i % 2:
            copy[dice.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    dice.shuffle(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {(r["doc_id"], r["duplicate_of"]) for r in got} == {(i, 0) for i in range(1, 300)}


def test_every_pair_up_to_the_threshold_is_linked(spark):
    """Pairs of 48 bits, and of fewer, wherever in the segments their bits lie: 3 in every one, 2 in every one but for some, or at random."""
    dice = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        a = dice.integers(0, 2, simhash.BITS, dtype=np.uint8)
        b = a.copy()
        if i % 3 == 0:
            counts = np.full(16, 3)
        elif i % 3 == 1:  # two bits in one segment, three or more in all others but those that make up for more
            counts = np.full(16, 3)
            counts[dice.integers(16)] -= 1
            counts[dice.choice(16, 2, replace=False)] += [1, -1] if i % 2 else [0, 0]
        else:
            counts = np.bincount(dice.integers(0, 16, dice.integers(32, 49)), minlength=16)
        for s, n in enumerate(counts):
            b[s * 20 + dice.choice(20, n, replace=False)] ^= 1
        assert (a != b).sum() <= simhash.MOST
        rows += [(2 * i + j, *np.packbits(x).view(np.int64).tolist()) for j, x in enumerate((a, b))]
    prints = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"f{k} long" for k in range(5)))
    for top in (None, 1, 6):
        got = {(min(r), max(r)) for r in map(tuple, simhash.near_edges(prints, top=top).collect())}
        assert got == {(2 * i, 2 * i + 1) for i in range(1200)}


def test_meeting_by_chance_costs_little(monkeypatch):
    """Of pairs of unlike rows that share a segment next to none get as far as chains, however many there are; and buckets of many groups lose no near pair."""
    dice = np.random.default_rng(5)
    half = dice.integers(0, 1 << simhash.HALF, (3000, 2 * simhash.SEGMENTS)).astype(np.uint16)
    half[:, :2] = 7
    half[1500:1600, 2:] = half[:100, 2:] ^ (dice.random((100, 30)) < 0.4)
    rolls = []
    monkeypatch.setattr(np, "roll", lambda a, *r, **k: rolls.append(len(a)) or a, raising=True)
    assert not len(simhash.chained(half[200:1400], half[1700:2900])) and sum(rolls) < 100
    monkeypatch.undo()
    value = np.full(3000, 7)
    d = np.bitwise_count(half[:, None, :] ^ half[None, :1600, :]).sum(axis=2)
    near = {(i, j) for i, j in zip(*np.nonzero(d <= simhash.MOST), strict=True) if i != j}
    got = simhash.linked(value, value == value, value, half, 17, simhash.MOST)
    assert len(near) >= 200 and grouped(range(3000), zip(*map(np.ndarray.tolist, got), strict=True)) == grouped(range(3000), near)
