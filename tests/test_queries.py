"""Every registered query of the engine against its SQL, on the smallest tables; and graph walks against brute force."""

import random

import duckdb
import pandas as pd
import pytest

from bough.model import Limits
from bough.operators import diff, files, graph, history, refs, search
from bough.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def dag(seed, n=60):
    dice = random.Random(seed)
    return [(k, p, i) for k in range(1, n) for i, p in enumerate(sorted(dice.sample(range(max(0, k - 9), k), min(k, dice.choice([0, 1, 1, 2])))))]


def up(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for c, p, _ in edges:
            if c == x and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("local", [0, 10**6])
def test_walks(spark, local):
    edges = dag(3)
    df = spark.createDataFrame(edges, "child long, parent long, idx int")
    start = spark.createDataFrame([(59,)], "oid long")
    assert {r[0] for r in graph.reachable(df, start, local).collect()} == up(edges, 59)
    assert graph.is_ancestor(df, 59, 59, local) and graph.is_ancestor(df, 5, 59, local) == (5 in up(edges, 59))
    both = up(edges, 59) & up(edges, 58)
    best = sorted((x for x in both if not any(x != y and x in up(edges, y) for y in both)), reverse=True)
    assert [r[0] for r in graph.merge_bases(df, 59, 58, local).orderBy("ordinal").collect()] == best


def test_orders():
    parents, time = {5: [4, 3], 4: [2], 3: [2], 2: [1], 1: []}, {5: 9, 4: 5, 3: 5, 2: 7, 1: 1}
    assert graph.order(5, parents, time) == [5, 4, 2, 3, 1]  # ties go to what was met first, a skewed clock comes early
    assert graph.order(5, parents, time, "date") == [5, 4, 3, 2, 1]
    assert graph.order(5, parents, time, "topological") == [5, 3, 4, 2, 1]
    assert graph.order(1, {1: [2], 2: [1]}, {1: 0, 2: 0}, "topological") == [2, 1]


def test_similar_pairs_against_brute_force(spark):
    from bough.functions import linediff

    dice = random.Random(2)
    pool = [b"line %d with some text\n" % i for i in range(60)]
    a = [(b"a%d" % i, b"".join(dice.choice(pool) for _ in range(dice.randrange(1, 12)))) for i in range(30)]
    b = [(b"b%d" % i, b"".join(x for x in dice.choice(a)[1].splitlines(keepends=True) if dice.random() < 0.8) or b"z") for i in range(30)]
    t = lambda rows: spark.createDataFrame([(bytearray(p), bytearray(d)) for p, d in rows], "path binary, data binary")
    got = {(bytes(r[0]), bytes(r[1])): r[2] for r in diff.similar(t(a), t(b)).collect()}
    want = {(p, q): s for p, x in a for q, y in b if (s := int(100 * linediff.similarity(x, y))) >= 50}
    assert got == want
    left, chosen = sorted(((-s, p, q) for (p, q), s in want.items())), {}
    for _, p, q in left:
        if p not in chosen and q not in chosen.values():
            chosen[p] = q
    df = spark.createDataFrame([(bytearray(p), bytearray(q), s) for (p, q), s in want.items()], "old_path binary, new_path binary, similarity int")
    assert {bytes(r[0]): bytes(r[1]) for r in diff.assign(df).collect()} == chosen


def test_attribution_over_a_merge():
    v = [("1", "f", [], b"a\nb\n"), ("2", "f", ["1"], b"a\nx\nb\n"), ("3", "g", ["1"], b"a\nb\ny\n"), ("4", "f", ["2", "3"], b"a\nx\nb\ny\nz\n")]
    assert history.attribute(v[::-1])["4"] == [("1", "f", 1), ("2", "f", 2), ("1", "f", 2), ("3", "g", 3), ("4", "f", 5)]


def test_layers_behind_a_hit_are_not_consulted(spark):
    rows = [[("a", "x", None)], [("a", None, "gone"), ("b", "y", None)], [("b", "z", None), ("c", None, "broken")]]
    layers = [spark.createDataFrame(r, "oid string, payload string, error string") for r in rows]
    assert sorted(map(tuple, files.layered(layers[:2]).collect())) == [("a", "x", 0), ("b", "y", 1)]
    with pytest.raises(Exception, match="backend_error: layer 2: broken"):
        files.layered(layers).collect()


def test_a_long_line_with_a_choice_is_found(spark):
    files_ = spark.createDataFrame([(bytearray(b"a"), 0o100644, "blob", "1", 80_003, bytearray(b"ab" * 40_000 + b"xyz"))], "path binary, mode int, kind string, oid string, size long, data binary")
    got = search.search(files_, "(?:x|y)(y|q)z|[0-9]", mode="regex").collect()
    assert [(r["line"], r["column"], [tuple(x) for x in r["submatches"]]) for r in got] == [(1, 80_000, [])]


def test_histories_are_whole():
    known = {"p": [(i, "modified") for i in range(3000)] + [(3000, "added")], "q": [(3001, "added")]}
    got = history.follow(lambda path, below: known[path], lambda commit, path: "q" if path == "p" else None, "p")
    assert len(got) == 3002 and got[-1] == ("q", 3001, "added")


def test_parts_of_a_log_make_the_whole(spark):
    """On random graphs and clocks that run backwards, parts of a few commits each give the walk of all."""
    for seed in range(3):
        edges = dag(seed, 50)
        dice = random.Random(seed)
        times = {k: dice.randrange(100) for k in range(50)}
        e, c = spark.createDataFrame(edges, "child long, parent long, idx int"), spark.createDataFrame(list(times.items()), "oid long, time long")
        parents = {}
        for child, p, _ in edges:
            parents.setdefault(child, []).append(p)
        want = graph.order(49, parents, times)
        got, at = [], 0
        while True:
            part, more = graph.log_part(c, e, 49, "time", limits=Limits(max_objects=6), at=at)
            got += [r["oid"] for r in part.orderBy("ordinal").collect()]
            if not more:
                break
            at += 6
        assert got == want


def as_tables(folder, **frames):
    for name, rows in frames.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{name}.parquet")
    c = duckdb.connect()
    for name in frames:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return c


def test_context_lines_that_are_cut(spark, tmp_path):
    """A hit is in the result of the query only where no neighbour is cut; the search itself tells."""
    said = ["license\n" + "x" * n for n in (5, 1024, 1025)] + ["é" * 512 + "\nlicense", "é" * 513 + "\nlicense", "y" * 2000 + "\nfar\nlicense\n"]
    c = as_tables(tmp_path, documents={"doc_id": range(6), "source": "s", "lang": "l", "text": said})
    got, want = QUERIES["search_context"](spark, str(tmp_path)).toPandas(), c.execute(ORACLES["search_context"]).df()
    assert rows(got) == rows(want) and len(got) == 4
    files_ = spark.createDataFrame([(bytearray(t.encode()), 0o100644, "blob", "1", 9, bytearray(t.encode())) for t in said], "path binary, mode int, kind string, oid string, size long, data binary")
    assert sorted(r["context_truncated"] for r in search.search(files_, "license", context_lines=1).collect()) == [False] * 4 + [True] * 2


def test_long_chains_of_tags(spark, tmp_path):
    """Chains of more than 16 tags are followed to their end, as in the query's SQL; circles end."""
    keys = [2**k for k in range(20)] + [3 * 2**k for k in range(19)] + [22, 11, 0]
    c = as_tables(tmp_path, customer={"c_custkey": keys})
    got, want = QUERIES["refs_peel"](spark, str(tmp_path)).toPandas(), c.execute(ORACLES["refs_peel"]).df()
    assert rows(got) == rows(want) and (got["status"] == "resolved").sum() > 35
    objects = spark.createDataFrame([(i, "tag") for i in range(1, 8)], "oid long, kind string")
    tags = spark.createDataFrame([(i, i + 1 if i < 7 else 3, "tag") for i in range(1, 8)], "oid long, target_oid long, target_kind string")
    got = refs.peel(objects, objects.select("oid"), tags, hops=None).collect()
    assert sorted(r["start"] for r in got) == list(range(1, 8)) and {r["status"] for r in got} == {"too_deep"}
    assert {(r["start"], r["oid"]) for r in refs.peel(objects, objects.select("oid").where("oid = 1"), tags, hops=2).collect()} == {(1, 3)}


@pytest.mark.parametrize(("named", "broadcast", "local"), [(0, 0, 0), (0, 2, 12), (0, 10**6, 0), (10**6, 0, 0)])
def test_walks_of_every_kind(spark, monkeypatch, named, broadcast, local):
    """Lookups by value, broadcast frontiers, edges that are taken out as they are joined, and the rest on the driver reach the same commits."""
    monkeypatch.setattr(graph, "NAMED", named)
    monkeypatch.setattr(graph, "BROADCAST", broadcast)
    edges = dag(4, 20)
    df = spark.createDataFrame([*edges, (1000, 1001, 0), (1001, 1000, 0)], "child long, parent long, idx int").coalesce(2)  # and a circle
    first = [19, 18, 17, 1000]
    got = [r[0] for r in graph.reachable(df, spark.createDataFrame([(x,) for x in first], "oid long"), local).collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*(up(edges, x) for x in first[:3]), first[3:], {1001})
    pairs = [(5, 19), (19, 19), (7, 19)]
    assert graph.are_ancestors(df, pairs, local) == [a in up(edges, d) for a, d in pairs]
    both = up(edges, 19) & up(edges, 18)
    best = sorted((x for x in both if not any(x != y and x in up(edges, y) for y in both)), reverse=True)
    assert [r[0] for r in graph.merge_bases(df, 19, 18, local).orderBy("ordinal").collect()] == best


def shuffled(spark, run):
    """Bytes that the stages of run() shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(x.shuffleWriteBytes() for x in (s.apply(i) for s in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(s.size())))
    before = total()
    run()
    return total() - before


def test_walks_of_large_graphs_shuffle_little(spark, monkeypatch):
    """A walk from a few commits shuffles no edges; one from all tips about as much as there are edges, however many levels there are."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    k = spark.range(1, 200_000).selectExpr("id as child")
    edges = k.selectExpr("child", "child div 2 as parent", "0 as idx")
    commits = spark.range(0, 200_000).selectExpr("id as oid", "id as t")
    assert shuffled(spark, lambda: graph.merge_bases(edges, 199_999, 199_995, 0).collect()) < 10_000
    assert shuffled(spark, lambda: graph.are_ancestors(edges, [(3, 199_999), (0, 150_000)], 0)) < 10_000
    assert shuffled(spark, lambda: graph.reachable(edges, commits.where("oid > 190000"), 0).count()) < 4_000_000
    (got,) = [r for r in graph.log(commits, edges, 199_999, "t", since_=20, until=700).collect() if r["ordinal"] == 0]
    assert got["oid"] == 199_999 >> 9


def test_many_alike_are_assigned_in_few_rounds(spark, monkeypatch):
    """Copies of one text and of its like are compared once, and how many they are adds no rounds; groups too large for a task give the same."""
    from bough.functions import linediff

    t = lambda rows: spark.createDataFrame([(bytearray(p), bytearray(d)) for p, d in rows], "path binary, data binary").coalesce(1)
    text = b"".join(b"line %d of a text\n" % i for i in range(9))
    a = [(b"a%03d" % i, text + b"more\n" * (i % 2)) for i in range(40)]
    b = [(b"b%03d" % (i * 7 % 30), text + b"appended\n" * (1 + i % 2)) for i in range(30)]
    pairs = diff.similar(t(a), t(b))
    want, olds, news = {}, set(), set()
    for s, p, q in sorted((-int(100 * linediff.similarity(x, y)), p, q) for p, x in a for q, y in b):
        if p not in olds and q not in news:
            want[p] = q
            olds.add(p)
            news.add(q)
    written = []
    real = diff.spill
    monkeypatch.setattr(diff, "spill", lambda df: written.append(1) or real(df))
    assert pairs.count() == 1200
    assert {bytes(r[0]): bytes(r[1]) for r in diff.assign(pairs).collect()} == want and len(written) < 10
    monkeypatch.setattr(diff, "GROUP", 100)
    assert {bytes(r[0]): bytes(r[1]) for r in diff.assign(pairs).collect()} == want
