"""The commit graph: reachability, ancestry, merge bases, ordered logs.

Edges are (child, parent, idx), idx counting a commit's parents from 0. A graph of at
most ``LOCAL_EDGES`` edges is walked on the driver, where a level costs no job; the
number is counted first. In a larger one a walk goes level by level: up to ``NAMED``
commits are looked up by value, in scans that shuffle nothing; more are joined, and
each level's commits are written out. The exact order of a log comes out of a priority queue
and is sequential by nature: it is made on the driver, over the reachable commits
alone, of which there may be ``max_objects``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bough.model import EngineError, Limits
from bough.plans.stages import spill

LOCAL_EDGES = 1_000_000
#: Commits of a level that are looked up by value, and those that are broadcast.
NAMED, BROADCAST = 1_000, 500_000
ORDERS = ("chronological", "topological", "date")


def first_parents(edges: DataFrame) -> DataFrame:
    return edges.where("idx = 0")


def cut_shallow(edges: DataFrame, shallow: DataFrame) -> DataFrame:
    """Edges without those of the commits (oid) at a shallow boundary."""
    return edges.join(shallow.select(F.col("oid").alias("child")), "child", "left_anti")


def since(edges: DataFrame, commits: DataFrame, time: str, bound: int) -> DataFrame:
    """Edges without the parents of commits older than the bound: the walk ends there."""
    young = commits.where(F.col(time) >= bound).select(F.col("oid").alias("child"))
    return edges.join(young, "child", "left_semi")


def _walk_local(edges: DataFrame, starts: list) -> set:
    got = edges.select("child", "parent").toArrow()
    child, parent = got["child"].to_numpy(zero_copy_only=False), got["parent"].to_numpy(zero_copy_only=False)
    if child.dtype == object:
        up: dict = {}
        for c, p in zip(child.tolist(), parent.tolist(), strict=True):
            up.setdefault(c, []).append(p)
        seen, todo = set(starts), list(starts)
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen
    order = np.argsort(child, kind="stable")
    child, parent = child[order], parent[order]
    seen = frontier = np.unique(np.array(starts, np.int64))
    while len(frontier):
        lo, hi = np.searchsorted(child, frontier, "left"), np.searchsorted(child, frontier, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        frontier = np.setdiff1d(parent[at], seen)
        seen = np.union1d(seen, frontier)
    return set(seen.tolist())


def _climb(edges: DataFrame, starts: list, wanted: set | None = None) -> dict | None:
    """Parents of the starts and of all their ancestors, looked up by value a level at a time, which shuffles nothing; None if they are too many for that. With ``wanted`` it ends when all of these are met."""
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    up: dict = {}
    frontier = set(starts)
    while frontier:
        if len(frontier) > NAMED or len(up) > LOCAL_EDGES:
            return None
        up.update((x, []) for x in frontier)
        if wanted is not None and wanted <= up.keys():
            break
        for r in edges.where(F.col("child").isin(*(bytearray(x) if isinstance(x, bytes) else x for x in frontier))).select("child", "parent").collect():
            up[plain(r[0])].append(plain(r[1]))
        frontier = {p for x in frontier for p in up[x]} - up.keys()
    return up


def _above(up: dict, start) -> set:
    """The start and all its ancestors, by their parents."""
    seen, todo = {start}, [start]
    while todo:
        more = [p for p in up[todo.pop()] if p not in seen]
        seen.update(more)
        todo += more
    return seen


def _spread(edges: DataFrame, starts: DataFrame, local_edges: int):
    """Tables (oid) that together are the starts and all their ancestors, level by level; what one holds others may hold, too.

    A large frontier's edges are taken out of the table of edges as it is joined, so
    a commit is left once, and what is left of the edges shrinks; few are walked on
    the driver. A small frontier is broadcast: neither edges nor what is known are
    shuffled.
    """
    kind = edges.schema["parent"].dataType.simpleString()
    rest, seen, frontier = edges.select("child", "parent"), starts, starts
    split = False
    while not frontier.isEmpty():
        yield frontier
        named = frontier.select(F.col("oid").alias("child"))
        n = frontier.count()
        if split and n <= local_edges and rest.count() <= local_edges:
            first = [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in frontier.collect()]
            yield edges.sparkSession.createDataFrame([(x,) for x in _walk_local(rest, first)], f"oid {kind}")
            return
        if n > BROADCAST:
            both = spill(rest.join(named.withColumn("hit", F.lit(True)), "child", "left"))
            frontier = spill(both.where("hit").select(F.col("parent").alias("oid")).distinct())
            rest, split = both.where("hit is null").select("child", "parent"), True
        else:
            up = spill(rest.join(F.broadcast(named), "child", "left_semi").select(F.col("parent").alias("oid")).distinct())
            known = seen.join(F.broadcast(up), "oid", "left_semi") if up.count() <= BROADCAST else seen
            frontier = spill(up.join(known.distinct(), "oid", "left_anti"))
        seen = seen.unionByName(frontier)


def reachable(edges: DataFrame, starts: DataFrame, local_edges: int = LOCAL_EDGES, among: DataFrame | None = None) -> DataFrame:
    """(oid) of the starts (oid) and all their ancestors, each once. Where edges are a part of others that are cheaper to count, those are ``among``."""
    return _reachable(edges, starts, local_edges, (edges if among is None else among).count() <= local_edges)


def _reachable(edges: DataFrame, starts: DataFrame, local_edges: int, few: bool) -> DataFrame:
    kind = edges.schema["parent"].dataType
    starts = starts.select(F.col("oid").cast(kind).alias("oid")).distinct()
    plain = lambda rows: [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in rows]
    table = lambda found: edges.sparkSession.createDataFrame([(x,) for x in sorted(found)], f"oid {kind.simpleString()}")
    if few:
        first = plain(starts.limit(local_edges + 1).collect())
        if len(first) <= local_edges:
            return table(_walk_local(edges, first))
    starts = spill(starts)
    first = plain(starts.limit(NAMED + 1).collect())
    up = _climb(edges, first) if len(first) <= NAMED else None
    if up is not None:
        return table(up)
    out = None
    for level in _spread(edges, starts, local_edges):
        out = level if out is None else out.unionByName(level)
    return starts if out is None else out.distinct()


def is_ancestor(edges: DataFrame, ancestor, descendant, local_edges: int = LOCAL_EDGES) -> bool:
    """Whether one commit is the other or among its ancestors; the walk ends when it is met."""
    return are_ancestors(edges, [(ancestor, descendant)], local_edges)[0]


def are_ancestors(edges: DataFrame, pairs: list[tuple], local_edges: int = LOCAL_EDGES) -> list[bool]:
    """is_ancestor of each pair (ancestor, descendant), by one walk a descendant."""
    met: dict = {d: {d} for _, d in pairs}
    few = None
    for d, found in met.items():
        wanted = {a for a, x in pairs if x == d} - found
        if not wanted:
            continue
        few = edges.count() <= local_edges if few is None else few
        up = _walk_local(edges, [d]) if few else _climb(edges, [d], wanted)
        if up is not None:
            found |= wanted & set(up)
            continue
        raw = [bytearray(x) if isinstance(x, bytes) else x for x in wanted]
        start = edges.sparkSession.createDataFrame([(d,)], f"oid {edges.schema['parent'].dataType.simpleString()}")
        for level in _spread(edges, spill(start), local_edges):
            found.update(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in level.where(F.col("oid").isin(*raw)).collect())
            if wanted <= found:
                break
    return [a in met[d] for a, d in pairs]


def merge_bases(edges: DataFrame, left, right, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(oid, ordinal): the best common ancestors, greatest id first.

    Common ancestors are closed under parents, so one is best unless it is a parent
    of another: a single anti-join, no walk for each.
    """
    spark, kind = edges.sparkSession, edges.schema["parent"].dataType.simpleString()
    few = edges.count() <= local_edges
    up = None if few else _climb(edges, [left, right])
    if up is not None:
        common = _above(up, left) & _above(up, right)
        best = sorted(common - {p for x in common for p in up[x]}, reverse=True)
        return spark.createDataFrame([(x, i) for i, x in enumerate(best, 1)], f"oid {kind}, ordinal int")
    a, b = (_reachable(edges, spark.createDataFrame([(x,)], f"oid {kind}"), local_edges, few) for x in (left, right))
    common = spill(a.join(b, "oid", "left_semi"))
    parents = edges.join(common.withColumnRenamed("oid", "child"), "child", "left_semi").select(F.col("parent").alias("oid"))
    best = common.join(parents, "oid", "left_anti")
    return best.select("oid", F.row_number().over(Window.orderBy(F.desc("oid"))).alias("ordinal"))


def child_counts(edges: DataFrame) -> DataFrame:
    """(oid, children) of every commit that has any."""
    return edges.groupBy(F.col("parent").alias("oid")).agg(F.count(F.lit(1)).alias("children"))


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(oid, level): length of the longest path from a start, for every reachable commit of an acyclic graph."""
    level = spill(starts.select("oid", F.lit(0).alias("level")).distinct())
    all_ = level
    n = 0
    while True:
        n += 1
        level = spill(edges.join(level.select(F.col("oid").alias("child")), "child", "left_semi").select(F.col("parent").alias("oid"), F.lit(n).alias("level")).distinct())
        if level.isEmpty():
            return all_.groupBy("oid").agg(F.max("level").alias("level"))
        all_ = all_.unionByName(level)


def order(start, parents: dict, time: dict, how: str = "chronological") -> list:
    """All commits reachable from start, in the order of a log; parents in encoded order."""
    if how == "chronological":
        heap, seen, n, out = [(-time[start], 0, start)], {start}, 1, []
        while heap:
            _, _, x = heapq.heappop(heap)
            out.append(x)
            for p in parents.get(x, ()):
                if p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (-time[p], n, p))
                    n += 1
        return out
    found: dict = {}
    todo = [start]
    while todo:
        x = todo.pop()
        if x in found:
            continue
        found[x] = len(found)
        todo += [p for p in reversed(parents.get(x, ())) if p not in found]
    children = dict.fromkeys(found, 0)
    for x in found:
        for p in parents.get(x, ()):
            children[p] += 1
    ready = sorted((x for x, c in children.items() if not c), key=lambda x: (time[x], found[x]))
    out, done = [], set()
    heap = [(-time[x], i, x) for i, x in enumerate(reversed(ready))]
    heapq.heapify(heap)
    n = len(heap)
    while ready if how == "topological" else heap:
        x = ready.pop() if how == "topological" else heapq.heappop(heap)[2]
        out.append(x)
        done.add(x)
        for p in parents.get(x, ()):
            children[p] -= 1
            if not children[p]:
                if how == "topological":
                    ready.append(p)
                else:
                    heapq.heappush(heap, (-time[p], n, p))
                    n += 1
    return out + sorted(set(found) - done, reverse=True)  # what lies on cycles


def log(commits: DataFrame, edges: DataFrame, start, time: str, how: str = "chronological", first_parent: bool = False, since_: int | None = None, until: int | None = None, limits: Limits | None = None) -> DataFrame:
    """(oid, time, ordinal) of the commits reachable from start, in exact order.

    since_ also ends the walk at older commits, until only hides younger ones. More
    reachable commits than max_objects are a budget_exceeded (but see ``log_part``).
    """
    return _log(commits, edges, start, time, how, first_parent, since_, until, limits, None)[0]


def log_part(commits: DataFrame, edges: DataFrame, start, time: str, first_parent: bool = False, since_: int | None = None, until: int | None = None, limits: Limits | None = None, at: int = 0) -> tuple[DataFrame, bool]:
    """The chronological log as far as max_objects commits behind the first ``at`` of the walk, and whether it goes on.

    Ordinals count the commits of the walk, also those that until hides, so a later
    part goes on at the last one's ordinal + 1.
    """
    return _log(commits, edges, start, time, "chronological", first_parent, since_, until, limits, at)


def _log(commits: DataFrame, edges: DataFrame, start, time: str, how: str, first_parent: bool, since_: int | None, until: int | None, limits: Limits | None, at: int | None) -> tuple[DataFrame, bool]:
    if how not in ORDERS:
        raise EngineError("invalid_argument", f"unknown order {how!r}")
    most = (limits or Limits()).max_objects
    spark, kind = edges.sparkSession, edges.schema["parent"].dataType.simpleString()
    edges = every = first_parents(edges) if first_parent else edges
    if since_ is not None:
        edges = since(edges, commits, time, since_)
    reach = spill(reachable(edges, spark.createDataFrame([(start,)], f"oid {kind}"), among=every))
    if reach.limit(most + 1).count() > most:
        if at is None:
            raise EngineError("budget_exceeded", "the walk reaches more commits than max_objects")
        return _first(commits, edges, start, time, since_, until, reach, at + most, at)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    times = {plain(r[0]): r[1] for r in commits.join(F.broadcast(reach), "oid", "left_semi").select("oid", time).collect()}  # max_objects at most
    if start not in times:
        raise EngineError("not_found", "there is no such commit")
    up: dict = {}
    for c, p, _ in sorted((plain(r[0]), plain(r[1]), r[2]) for r in edges.join(F.broadcast(reach.withColumnRenamed("oid", "child")), "child", "left_semi").select("child", "parent", "idx").collect()):
        up.setdefault(c, []).append((_, p))
    missing = {p for ps in up.values() for _, p in ps} - set(times)
    if missing:
        raise EngineError("missing_object", "a parent isn't in the store", count=len(missing))
    parents = {c: [p for _, p in sorted(ps, key=lambda x: x[0])] for c, ps in up.items()}
    shown = lambda x: (since_ is None or times[x] >= since_) and (until is None or times[x] <= until)
    walk = order(start, parents, times, how)
    if at is not None:
        rows = [(x, times[x], i) for i, x in enumerate(walk) if i >= at and shown(x)]
    else:
        rows = [(x, times[x], i) for i, x in enumerate(filter(shown, walk))]
    return spark.createDataFrame(rows, f"oid {kind}, time long, ordinal long"), False


def _first(commits: DataFrame, edges: DataFrame, start, time: str, since_: int | None, until: int | None, reach: DataFrame, most: int, at: int) -> tuple[DataFrame, bool]:
    """The first ``most`` commits of the chronological walk without those before ``at``: the youngest of the commits reached are loaded at once, others when the walk comes to them."""
    spark, kind = edges.sparkSession, edges.schema["parent"].dataType.simpleString()
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    raw = lambda x: bytearray(x) if isinstance(x, bytes) else x
    timed = commits.join(reach, "oid", "left_semi").select("oid", F.col(time).alias("time"))
    times: dict = {}
    parents: dict = {}

    def load(ids: list) -> None:
        wanted = spark.createDataFrame([(raw(x),) for x in ids], f"child {kind}")
        rows = edges.join(F.broadcast(wanted), "child").select("child", "parent", "idx")  # max_objects ids at most
        for c, p, _ in sorted(((plain(r[0]), plain(r[1]), r[2]) for r in rows.collect()), key=lambda r: (r[0], r[2])):
            parents[c].append(p)
        lack = [p for c in ids for p in parents[c] if p not in times]
        if lack:
            more = spark.createDataFrame([(raw(x),) for x in set(lack)], f"oid {kind}")
            times.update((plain(r[0]), r[1]) for r in timed.join(F.broadcast(more), "oid").collect())
            if any(p not in times for p in lack):
                raise EngineError("missing_object", "a parent isn't in the store")

    for r in timed.orderBy(F.desc("time")).limit(most).collect():
        times[plain(r[0])] = r[1]
    if start not in times:
        times[start] = timed.where(F.col("oid") == F.lit(raw(start))).first()[1]
    first = list(times)
    parents.update((x, []) for x in first)
    load(first)
    heap, seen, n, out = [(-times[start], 0, start)], {start}, 1, []
    while heap and len(out) < most:
        _, _, x = heapq.heappop(heap)
        if x not in parents:
            ids = [x] + [y for _, _, y in heap if y not in parents]
            parents.update((y, []) for y in ids)
            load(ids)
        out.append(x)
        for p in parents[x]:
            if p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-times[p], n, p))
                n += 1
    rows = [(raw(x), times[x], i) for i, x in enumerate(out) if i >= at and (since_ is None or times[x] >= since_) and (until is None or times[x] <= until)]
    return spark.createDataFrame(rows, f"oid {kind}, time long, ordinal long"), bool(heap)


def log_monotone(commits: DataFrame, edges: DataFrame, start, time: str) -> DataFrame:
    """As the chronological log, for a clock that no edge runs backwards on and without ties: then the order is by time, for any number of commits.

    Ranks are made by range-partitioned sorting, not in one task.
    """
    spark, kind = edges.sparkSession, edges.schema["parent"].dataType.simpleString()
    reach = reachable(edges, spark.createDataFrame([(start,)], f"oid {kind}"))
    rows = spill(commits.join(reach, "oid", "left_semi").select("oid", F.col(time).alias("time")).repartitionByRange(F.desc("time")).withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("oid", "time", (F.row_number().over(Window.partitionBy("part").orderBy(F.desc("time"))) - 1 + F.col("before")).alias("ordinal"))
