"""Differences of two snapshots: statuses, renames, line counts, hunks.

The summary is one full outer join on the path. Exact renames are a join on the
object id. Inexact ones need no product of deletions and additions: a pair whose
lines agree in half of the larger side's bytes must share one of the rarest lines
that hold more than half of either side's bytes (prefix filtering), so candidates are
an equi-join on those, and only candidates are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bough.functions import linediff
from bough.functions import octets as O
from bough.functions import pathspec
from bough.model import EngineError
from bough.plans.stages import spill

SIMILAR = 0.5
#: Pairs of a group that one task goes through.
GROUP = 4_000_000
FORMATS = ("summary", "stats", "patch")


def summary(base: DataFrame, head: DataFrame, pathspecs: list[str] | None = None) -> DataFrame:
    """(status, old_path, new_path, old_oid, new_oid, old_mode, new_mode) of paths that differ; base and head are (path, mode, oid).

    Pathspecs are applied to both sides, before any renames are looked for.
    """
    wanted = lambda df: df.where(pathspec.matches(O.chars(F.col("path")), pathspecs or []))
    a = wanted(base).select(F.col("path").alias("old_path"), F.col("mode").alias("old_mode"), F.col("oid").alias("old_oid"))
    b = wanted(head).select(F.col("path").alias("new_path"), F.col("mode").alias("new_mode"), F.col("oid").alias("new_oid"))
    both = a.join(b, F.col("old_path") == F.col("new_path"), "full_outer").where("not (old_oid <=> new_oid and old_mode <=> new_mode)")
    kind = lambda c: F.col(c).bitwiseAND(F.lit(O.FILE_TYPE))
    status = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").when(kind("old_mode") != kind("new_mode"), "type_changed").otherwise("modified")
    return both.select(status.alias("status"), "old_path", "new_path", "old_oid", "new_oid", "old_mode", "new_mode")


def _pairs_of(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Exact renames, one to one: of several deletions and additions of one object the n-th goes with the n-th, by path."""
    nth = lambda df, c, o, n: df.withColumn(n, F.row_number().over(Window.partitionBy(o).orderBy(c)))
    a, b = nth(deleted, "old_path", "old_oid", "n"), nth(added, "new_path", "new_oid", "m")
    same = O.FILE_TYPE
    return a.join(b, (F.col("old_oid") == F.col("new_oid")) & (F.col("n") == F.col("m")) & (F.col("old_mode").bitwiseAND(F.lit(same)) == F.col("new_mode").bitwiseAND(F.lit(same)))).select("old_path", "new_path", F.lit(100).alias("similarity"))


def _prefixes(side: DataFrame) -> DataFrame:
    """(id, key): for each text the occurrences of its rarest lines that hold over half of its bytes; side is (id, data, side)."""
    lines = side.select("side", "id", F.posexplode(O.lines(O.chars(F.col("data")))).alias("at", "line"), F.octet_length("data").alias("size"))
    hashed = lines.select("side", "id", "size", F.xxhash64("line").alias("h"), (F.length("line") + 1).alias("bytes"), "at")
    counted = hashed.withColumn("occurrence", F.row_number().over(Window.partitionBy("side", "id", "h").orderBy("at"))).withColumn("key", F.xxhash64("h", "occurrence"))
    often = counted.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    ranked = counted.join(often, "key").withColumn("before", F.sum("bytes").over(Window.partitionBy("side", "id").orderBy("often", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
    return ranked.where(F.col("before") <= F.col("size") * (1 - SIMILAR)).select("side", "id", "key").distinct()


def similar(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(old_path, new_path, similarity) of all pairs (path, data) alike in half of their bytes; empty ones have no partner."""
    named = lambda df, side: df.where("octet_length(data) > 0").select(F.lit(side).alias("side"), "path", F.sha1("data").alias("id"), "data")
    a, b = named(deleted, "a"), named(added, "b")
    # copies of one text are compared once
    ones = lambda df: df.select("side", "id", "data").dropDuplicates(["id"])
    keys = spill(_prefixes(ones(a).unionByName(ones(b))))
    left = keys.where("side = 'a'").select("key", F.col("id").alias("old_id"))
    right = keys.where("side = 'b'").select("key", F.col("id").alias("new_id"))
    candidates = left.join(right, "key").select("old_id", "new_id").distinct()
    with_data = candidates.join(ones(a).select(F.col("id").alias("old_id"), F.col("data").alias("old")), "old_id").join(ones(b).select(F.col("id").alias("new_id"), F.col("data").alias("new")), "new_id")
    near = with_data.where("least(octet_length(old), octet_length(new)) >= 0.5 * greatest(octet_length(old), octet_length(new))")

    def score(batches):
        for batch in batches:
            s = [int(100 * linediff.similarity(x, y)) for x, y in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("old_id"), batch.column("new_id"), pa.array(s, pa.int32())], ["old_id", "new_id", "similarity"])

    scored = near.select("old_id", "new_id", "old", "new").mapInArrow(score, "old_id string, new_id string, similarity int").where(F.col("similarity") >= int(100 * SIMILAR))
    return scored.join(a.select(F.col("id").alias("old_id"), F.col("path").alias("old_path")), "old_id").join(b.select(F.col("id").alias("new_id"), F.col("path").alias("new_path")), "new_id").select("old_path", "new_path", "similarity")


def assign(pairs: DataFrame) -> DataFrame:
    """The greedy one-to-one choice, most similar first, ties by path.

    Pairs that hang together are in one group, and groups don't touch each other: each is
    gone through in one task. Of groups of more than ``GROUP`` pairs those are taken that
    are best for both of their sides, round by round.
    """
    linked = spill(pairs.select("old_path", "new_path", "similarity", F.col("old_path").alias("least"), F.lit(True).alias("changed")))
    while not linked.where("changed").isEmpty():
        over = lambda c, *by: F.min(c).over(Window.partitionBy(*by))
        lower = linked.withColumn("now", over("least", "new_path")).withColumn("now", over("now", "old_path"))
        linked = spill(lower.select("old_path", "new_path", "similarity", F.col("now").alias("least"), (F.col("now") < F.col("least")).alias("changed")))
    large = linked.groupBy("least").count().where(F.col("count") > GROUP).select("least")
    rows = linked.drop("changed")
    taken = rows.join(large, "least", "left_anti").groupBy("least").applyInArrow(_greedy, "old_path binary, new_path binary, similarity int")
    rest = spill(rows.join(large, "least", "left_semi").drop("least"))
    return spill(taken) if rest.isEmpty() else spill(taken).unionByName(_rounds(rest))


def _greedy(group: pa.Table) -> pa.Table:
    ranks = [pc.rank(group[c].cast(pa.large_binary()), tiebreaker="dense").to_numpy() for c in ("old_path", "new_path")]
    order = np.lexsort((ranks[1], ranks[0], -group["similarity"].to_numpy()))
    free = [bytearray(b"\1") * (int(r.max()) + 1) for r in ranks]
    out = []
    for i, a, b in zip(order.tolist(), ranks[0][order].tolist(), ranks[1][order].tolist(), strict=True):
        if free[0][a] and free[1][b]:
            free[0][a] = free[1][b] = 0
            out.append(i)
    return group.select(["old_path", "new_path", "similarity"]).take(pa.array(out, pa.int64()))


def _rounds(left: DataFrame) -> DataFrame:
    """The same choice by rounds."""
    taken = left.limit(0)
    order = [F.desc("similarity"), "old_path", "new_path"]
    while not left.isEmpty():
        ranked = left.withColumn("a", F.row_number().over(Window.partitionBy("old_path").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("new_path").orderBy(*order)))
        best = spill(ranked.where("a = 1 and b = 1").drop("a", "b"))
        taken = taken.unionByName(best)
        left = spill(left.join(best.select("old_path"), "old_path", "left_anti").join(best.select("new_path"), "new_path", "left_anti"))
    return taken.select("old_path", "new_path", "similarity")


def renames(changes: DataFrame, base: DataFrame | None = None, head: DataFrame | None = None) -> DataFrame:
    """changes, with deletions and additions that are one file put together as "renamed", and similarity. With base and head (path, data) also inexact ones."""
    deleted = changes.where("status = 'deleted'").select("old_path", "old_oid", "old_mode")
    added = changes.where("status = 'added'").select("new_path", "new_oid", "new_mode")
    pairs = _pairs_of(deleted, added)
    if base is not None and head is not None:
        pairs = spill(pairs)
        a = base.join(deleted.join(pairs, "old_path", "left_anti").where(F.col("old_mode").bitwiseAND(F.lit(O.FILE_TYPE)) == 0o100000).select(F.col("old_path").alias("path")), "path", "left_semi").select("path", "data")
        b = head.join(added.join(pairs, "new_path", "left_anti").where(F.col("new_mode").bitwiseAND(F.lit(O.FILE_TYPE)) == 0o100000).select(F.col("new_path").alias("path")), "path", "left_semi").select("path", "data")
        pairs = pairs.unionByName(assign(similar(a, b)))
    moved = pairs.join(deleted, "old_path").join(added, "new_path").select(F.lit("renamed").alias("status"), "old_path", "new_path", "old_oid", "new_oid", "old_mode", "new_mode", "similarity")
    rest = changes.join(pairs.select(F.col("old_path").alias("x")), (F.col("status") == "deleted") & (F.col("old_path") == F.col("x")), "left_anti").join(pairs.select(F.col("new_path").alias("y")), (F.col("status") == "added") & (F.col("new_path") == F.col("y")), "left_anti")
    return rest.withColumn("similarity", F.lit(None).cast("int")).unionByName(moved)


def _contents(changes: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    a = base.select(F.col("path").alias("bp"), F.col("data").alias("old"))
    b = head.select(F.col("path").alias("hp"), F.col("data").alias("new"))
    return changes.join(a, F.col("old_path") == F.col("bp"), "left").join(b, F.col("new_path") == F.col("hp"), "left").drop("bp", "hp")


_NUL = b"\0"


def _counts(status: str, old_oid, new_oid, old_mode: int | None, new_mode: int | None, old: bytes | None, new: bytes | None, most: int) -> tuple[int | None, int | None, bool, bool]:
    """(additions, deletions, binary, oversize)."""
    if 0o160000 in ((old_mode or 0) & 0o170000, (new_mode or 0) & 0o170000):
        return int(new_oid is not None), int(old_oid is not None), False, False
    if old_oid == new_oid:
        return 0, 0, False, False
    old, new = old or b"", new or b""
    if max(len(old), len(new)) > most:
        return None, None, False, True
    if _NUL in old[: O.PROBE] or _NUL in new[: O.PROBE]:
        return None, None, True, False
    return (*linediff.counts(old, new), False, False)


_COUNTED = ("status", "old_oid", "new_oid", "old_mode", "new_mode", "old", "new")


def stats(changes: DataFrame, base: DataFrame, head: DataFrame, max_object_bytes: int = 4 << 20) -> DataFrame:
    """changes with additions, deletions (null for binary and oversize files), binary and oversize."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in _COUNTED), strict=True)
            out = [_counts(*r, max_object_bytes) for r in rows]
            kept = [c for c in batch.schema.names if c not in ("old", "new")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_())))], [*kept, "additions", "deletions", "binary", "oversize"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema)
    return _contents(changes, base, head).mapInArrow(run, f"{fields}, additions long, deletions long, binary boolean, oversize boolean")


def patch(changes: DataFrame, base: DataFrame, head: DataFrame, context: int = 3, max_object_bytes: int = 4 << 20) -> DataFrame:
    """A row for each line of each hunk: (old_path, new_path, status, hunk, old_start, old_lines, new_start, new_lines, at, origin, content, old_line, new_line, no_newline)."""
    if not 0 <= context <= 32:
        raise EngineError("invalid_argument", "context_lines lies between 0 and 32")

    def run(batches):
        for batch in batches:
            out = []
            for old_path, new_path, *r in zip(*(batch.column(c).to_pylist() for c in ("old_path", "new_path", *_COUNTED)), strict=True):
                status, a, b, am, bm, old, new = r
                old, new = old or b"", new or b""
                gitlink = 0o160000 in ((am or 0) & 0o170000, (bm or 0) & 0o170000)
                if gitlink or a == b or max(len(old), len(new)) > max_object_bytes or _NUL in old[: O.PROBE] or _NUL in new[: O.PROBE]:
                    continue
                for k, h in enumerate(linediff.replaced(old, new) if status == "type_changed" else linediff.hunks(old, new, context)):
                    out += [(old_path, new_path, status, k, h.old_start, h.old_lines, h.new_start, h.new_lines, i, *line) for i, line in enumerate(h.lines)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(_LINES)], [n for n, _ in _LINES])

    schema = ", ".join(f"{n} {dict(string='string', binary='binary', int64='long', bool='boolean')[str(t)]}" for n, t in _LINES)
    return _contents(changes, base, head).mapInArrow(run, schema)


_LINES = [("old_path", pa.binary()), ("new_path", pa.binary()), ("status", pa.string()), ("hunk", pa.int64()), ("old_start", pa.int64()), ("old_lines", pa.int64()), ("new_start", pa.int64()), ("new_lines", pa.int64()), ("at", pa.int64()), ("origin", pa.string()), ("content", pa.binary()), ("old_line", pa.int64()), ("new_line", pa.int64()), ("no_newline", pa.bool_())]


def sort_path(df: DataFrame) -> DataFrame:
    """By the new path, or else the old one, then the old one."""
    return df.orderBy(F.coalesce("new_path", "old_path"), F.col("old_path").asc_nulls_first())
