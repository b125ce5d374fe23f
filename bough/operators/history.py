"""History of paths, and attribution of lines (blame).

A commit is in a path's history if the path's (oid, mode) there differs from that in
the commit's first parent; a root is if it has the path. Lines are attributed along
all parents: each commit takes over, from the first parent that has it, what a line
diff leaves unchanged, and is itself the origin of the rest. Paths are independent of
each other and are worked on in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bough.functions import linediff
from bough.model import EngineError


def history(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit, path, action, oid, mode) for every path: states is (commit, path, oid, mode), edges (child, parent, idx)."""
    first = edges.where("idx = 0").select("child", "parent")
    before = states.select(F.col("commit").alias("c"), F.col("path").alias("p"), F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    now = states.join(first, F.col("commit") == F.col("child"), "left").join(before, (F.col("parent") == F.col("c")) & (F.col("path") == F.col("p")), "left")
    changed = now.where("not (oid <=> old_oid and mode <=> old_mode)").select("commit", "path", F.when(F.col("c").isNull(), "added").otherwise("modified").alias("action"), "oid", "mode")
    here = states.select(F.col("commit").alias("hc"), F.col("path").alias("hp"))
    gone = first.join(before, F.col("parent") == F.col("c")).join(here, (F.col("child") == F.col("hc")) & (F.col("p") == F.col("hp")), "left_anti")
    null = lambda c: F.lit(None).cast(states.schema[c].dataType).alias(c)
    return changed.unionByName(gone.select(F.col("child").alias("commit"), F.col("p").alias("path"), F.lit("deleted").alias("action"), null("oid"), null("mode")))


def follow(history_of, renamed_from, path) -> list[tuple]:
    """(path, commit, action) along renames, newest first: history_of(path, below) gives a path's history below a commit in log order, renamed_from(commit, path) the old path or None."""
    if not path:
        raise EngineError("invalid_path", "the root has no history")
    out, below = [], None
    while path is not None:
        source = None
        for commit, action in history_of(path, below):
            out.append((path, commit, action))
            if action == "added" and (source := renamed_from(commit, path)) is not None:
                below = commit
                break
        path = source
    return out


def attribute(versions: list[tuple]) -> dict:
    """For each version (id, path, parents, data): (id, path, line) of the origin of each of its lines. Versions in any order."""
    by = {v[0]: v for v in versions}
    done: dict = {}
    todo = list(by)
    while todo:
        x = todo[-1]
        if x in done:
            todo.pop()
            continue
        _, path, parents, data = by[x]
        wait = [p for p in parents if p in by and p not in done]
        if wait:
            todo += wait
            continue
        lines = linediff.split(data)
        origin: list = [None] * len(lines)
        for p in parents:
            if p not in by:
                continue
            old = linediff.split(by[p][3])
            gone, added = linediff.changes(old, lines)
            kept = [i for i, d in enumerate(gone) if not d]
            for k, j in enumerate(j for j, d in enumerate(added) if not d):
                if origin[j] is None:
                    origin[j] = done[p][kept[k]]
        done[x] = [o or (x, path, j + 1) for j, o in enumerate(origin)]
        todo.pop()
    return done


def blame(versions: DataFrame) -> DataFrame:
    """Attribution of every line of every version.

    versions: (file, commit, path, parents, data) with string commits; file holds a
    path's versions together, over its renames. Returns (file, commit, path, line_no,
    origin_commit, origin_path, origin_line). Data with NULs count as text.
    """

    def run(rows: pa.Table) -> pa.Table:
        names = ("commit", "path", "parents", "data")
        done = attribute(list(zip(*(rows[c].to_pylist() for c in names), strict=True)))
        file, paths = rows["file"][0].as_py(), dict(zip(rows["commit"].to_pylist(), rows["path"].to_pylist(), strict=True))
        out = [(file, c, paths[c], i + 1, *o) for c, origins in done.items() for i, o in enumerate(origins)]
        fields = ("file", "commit", "path", "line_no", "origin_commit", "origin_path", "origin_line")
        types = (rows.schema.field("file").type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(fields, types, strict=True))})

    kind = versions.schema["file"].dataType.simpleString()
    rows = versions.select("file", F.col("commit").cast("string").alias("commit"), F.col("path").cast("string").alias("path"), F.col("parents").cast("array<string>").alias("parents"), "data")
    return rows.groupBy("file").applyInArrow(run, f"file {kind}, commit string, path string, line_no long, origin_commit string, origin_path string, origin_line long")


def hunks(blamed: DataFrame) -> DataFrame:
    """Runs of lines of one version whose origins follow each other: (file, commit, final_start, final_end, origin_commit, origin_path, original_start, original_end)."""
    w = Window.partitionBy("file", "commit").orderBy("line_no")
    same = F.lag("origin_commit").over(w).eqNullSafe(F.col("origin_commit"))
    same = same & F.lag("origin_path").over(w).eqNullSafe(F.col("origin_path")) & (F.lag("origin_line").over(w) + 1 == F.col("origin_line"))
    runs = blamed.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return runs.groupBy("file", "commit", "run", "origin_commit", "origin_path").agg(F.min("line_no").alias("final_start"), F.max("line_no").alias("final_end"), F.min("origin_line").alias("original_start"), F.max("origin_line").alias("original_end")).drop("run")


def with_boundary(hunks_: DataFrame, edges: DataFrame) -> DataFrame:
    """hunks and ``boundary``: whether their origin has no parents."""
    inner = edges.select(F.col("child").cast("string").alias("origin_commit"), F.lit(False).alias("b")).distinct()
    return hunks_.join(inner, "origin_commit", "left").withColumn("boundary", F.coalesce("b", F.lit(True))).drop("b")
