"""Repositories, snapshots and their queries, with defaults, checks, limits and pages.

A repository is a set of relations; a snapshot pins one commit of it. Every query is
a DataFrame plan; only its bounded page comes to the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.functions import octets as O
from bough.jobs import Job, Runtime
from bough.model import EngineError, Limits, Page
from bough.operators import diff as D
from bough.operators import files as R
from bough.operators import graph, history, objects, paging, refs, search, submodules, tree
from bough.plans.stages import spill
from bough.sources import packs, refstore


@dataclass(eq=False)
class Repository:
    """objects (oid, kind, size, data), references, and the commits at a shallow boundary."""

    spark: SparkSession
    objects: DataFrame
    refs: DataFrame | None = None
    shallow: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, require_bare: bool = False) -> Repository:
        """A repository on disk: a bare folder, or one with a .git folder in it. The working tree isn't read."""
        inner = os.path.join(folder, ".git")
        if os.path.isdir(inner):
            if require_bare:
                raise EngineError("invalid_argument", "the repository isn't bare")
            folder = inner
        if not os.path.isdir(os.path.join(folder, "objects")):
            raise EngineError("not_found", "there is no repository")
        return cls(spark, packs.read_store(spark, os.path.join(folder, "objects")), refstore.read(spark, folder), refstore.shallow(spark, folder))

    @cached_property
    def commits(self) -> DataFrame:
        return spill(objects.commits(self.objects))

    @cached_property
    def edges(self) -> DataFrame:
        edges = objects.commit_edges(self.commits)
        return graph.cut_shallow(edges, self.shallow) if self.shallow is not None else edges

    @cached_property
    def tags(self) -> DataFrame:
        return spill(objects.tags(self.objects))

    @cached_property
    def tree_entries(self) -> DataFrame:
        return spill(objects.tree_entries(self.objects))

    def header(self, oid: bytes) -> tuple[str, int]:
        row = R.headers(self.objects).where(F.col("oid") == F.lit(oid)).first()
        if row is None:
            raise EngineError("not_found", "there is no such object")
        return row["kind"], row["size"]

    def read(self, oid: bytes, max_bytes: int | None = None, limits: Limits | None = None) -> tuple[str, bytes]:
        """(kind, data), whole or not at all."""
        if max_bytes is not None and max_bytes < 0:
            raise EngineError("invalid_argument", "max_bytes can't be negative")
        most = (limits or Limits()).max_object_bytes
        most = most if max_bytes is None else min(max_bytes, most)
        if self.header(oid)[1] > most:
            raise EngineError("object_too_large", "the object exceeds the ceiling")
        row = R.checked(self.objects.where(F.col("oid") == F.lit(oid))).first()
        return row["kind"], bytes(row["data"])

    def read_many(self, oids: list[bytes], limits: Limits | None = None) -> dict[bytes, tuple[str, bytes] | None]:
        """Each id with (kind, data), or None where there is no such object."""
        wanted = self.spark.createDataFrame([(bytearray(o),) for o in oids], "oid binary")
        got = R.read_many(self.objects, wanted, (limits or Limits()).max_total_object_bytes).collect()
        return {bytes(r["oid"]): (r["kind"], bytes(r["data"])) if r["found"] else None for r in got}

    def resolve(self, name: str) -> bytes:
        """The id that a reference stands for, symbolic ones followed."""
        if self.refs is None:
            raise EngineError("unsupported_operation", "the repository has no references")
        wanted = self.spark.createDataFrame([(bytearray(name.encode()),)], "name binary")
        row = refs.resolve(self.refs.select("name", "kind", "oid", "symbolic_target"), wanted).first()
        if row["status"] == "not_found":
            raise EngineError("ref_not_found", f"no reference {name}")
        if row["status"] != "resolved":
            raise EngineError("malformed_ref", f"{name}: {row['status']}")
        return bytes(row["oid"])

    def list_refs(self, prefix: str | None = None, limit: int = 100, cursor: str | None = None) -> Page:
        if self.refs is None:
            raise EngineError("unsupported_operation", "the repository has no references")
        warnings = [f"malformed reference {r[0]!r}" for r in refs.malformed(self.refs).limit(100).collect()]
        return paging.page(refs.listing(self.refs, prefix), ["name"], "refs", bytes(20), {"prefix": prefix}, limit, cursor, warnings=warnings)

    def peel(self, oid: bytes, to: str = "commit") -> bytes:
        """The object behind tags, as a commit, a tree (also of a commit) or a blob."""
        if to not in ("commit", "tree", "blob"):
            raise EngineError("invalid_argument", f"can't peel to {to!r}")
        start = self.spark.createDataFrame([(bytearray(oid),)], "oid binary")
        row = refs.peel(self.objects.select("oid", "kind"), start, self.tags, to).first()
        if row["status"] == "wrong_kind" and to == "tree" and row["kind"] == "commit":
            return bytes(self.commits.where(F.col("oid") == row["oid"]).first()["tree_oid"])
        if row["status"] != "resolved":
            code = {"not_found": "missing_object", "wrong_kind": {"commit": "not_a_commit", "tree": "not_a_tree", "blob": "not_a_blob"}[to]}.get(row["status"], "malformed_object")
            raise EngineError(code, f"peeling ends: {row['status']}")
        return bytes(row["oid"])

    def snapshot(self, kind: str, value: str | None = None) -> Snapshot:
        """By oid, ref, branch, tag or head; tags are peeled, also those that an id names."""
        how, target = refs.selector(kind, value)
        oid = bytes.fromhex(target) if how == "oid" else self.resolve(target)
        if kind in ("oid", "tag"):
            oid = self.peel(oid)
        row = self.commits.where(F.col("oid") == F.lit(oid)).first()
        if row is None:
            raise EngineError("not_a_commit", "the selector doesn't name a commit")
        return Snapshot(self, oid, bytes(row["tree_oid"]))

    def merge_base(self, left: bytes, right: bytes, all: bool = False) -> list[bytes] | bytes | None:  # noqa: A002
        for x in (left, right):
            if self.commits.where(F.col("oid") == F.lit(x)).isEmpty():
                raise EngineError("not_a_commit", "an id isn't a commit's")
        found = [bytes(r["oid"]) for r in graph.merge_bases(self.edges, left, right).orderBy("ordinal").collect()]
        return found if all else (found[0] if found else None)

    def is_ancestor(self, ancestor: bytes, descendant: bytes) -> bool:
        for x in (ancestor, descendant):
            if self.commits.where(F.col("oid") == F.lit(x)).isEmpty():
                raise EngineError("not_a_commit", "an id isn't a commit's")
        return graph.is_ancestor(self.edges, ancestor, descendant)


@dataclass(eq=False)
class Snapshot:
    """One commit and its tree."""

    repository: Repository
    commit_oid: bytes
    tree_oid: bytes

    def paths(self, pathspecs: list[str] | None = None, scope: str = "") -> DataFrame:
        return tree.expand(self.repository.tree_entries, self.tree_oid, pathspecs=pathspecs, scope=scope)

    @cached_property
    def files(self) -> DataFrame:
        """(path, mode, kind, oid, size, data) of all that isn't a tree; gitlinks have no data."""
        p = self.paths().where("kind <> 'tree'").select("path", "mode", F.col("kind").alias("entry"), F.col("oid").alias("o"))
        return p.join(self.repository.objects.select("oid", "size", "data"), F.col("o") == F.col("oid"), "left").select("path", "mode", F.col("entry").alias("kind"), F.col("o").alias("oid"), "size", "data")

    def list_tree(self, path: str = "", recursive: bool = False, depth: int | None = None, types: tuple[str, ...] = tree.KINDS, pathspecs: list[str] | None = None, include: tuple[str, ...] = (), limit: int = 1000, cursor: str | None = None, limits: Limits | None = None) -> Page:
        if set(include) - {"size"}:
            raise EngineError("invalid_argument", "include knows size alone")
        mode, kind, _ = tree.resolve(self.repository.tree_entries, self.tree_oid, path)
        if kind != "tree":
            raise EngineError("not_a_tree", "the path isn't a directory's")
        if depth == 0:
            return Page([], stats={"entries_emitted": 0, "stopped_by": None})
        rows = tree.listing(self.paths(pathspecs, path).drop("depth", "sort_key"), path, recursive, depth, types, pathspecs)
        if "size" in include:
            sizes = R.headers(self.repository.objects).select(F.col("oid").alias("o"), "size")
            rows = rows.join(sizes, (F.col("oid") == F.col("o")) & F.col("kind").isin("blob", "symlink"), "left").drop("o")
        options = {"path": path, "recursive": recursive, "depth": depth, "types": sorted(types), "pathspecs": pathspecs, "include": sorted(include)}
        return paging.page(rows, ["sort_key"], "list_tree", self.commit_oid, options, limit, cursor, limits)

    def read_file(self, path: str | bytes, lines: tuple[int, int] | range | None = None, max_bytes: int = R.MAX_BYTES, limits: Limits | None = None) -> Any:
        if isinstance(lines, range):
            lines = (lines[0], lines[-1]) if len(lines) else (1, 0)
        mode, kind, oid = tree.resolve(self.repository.tree_entries, self.tree_oid, path)
        if kind == "tree":
            raise EngineError("not_a_blob", "the path is a directory's")
        raw = path.encode() if isinstance(path, str) else path
        head = self.repository.spark.createDataFrame([(bytearray(raw), mode, bytearray(oid))], "path binary, mode int, oid binary")
        if kind == "gitlink":
            rows = head.withColumn("data", F.lit(None).cast("binary"))
        else:
            rows = head.join(self.repository.objects.where(F.col("oid") == F.lit(oid)).select("oid", "data"), "oid")
        row = R.read(rows, lines, min(max_bytes, (limits or Limits()).max_object_bytes)).first()
        if row is None:
            raise EngineError("missing_object", "the file's object isn't in the store")
        return row

    def search(self, query: str, mode: str = "literal", case_sensitive: bool = True, path: str = "", pathspecs: list[str] | None = None, binary: str = "skip", context_lines: int = 0, limit: int = 1000, cursor: str | None = None, limits: Limits | None = None) -> Page:
        limits = limits or Limits()
        most = limits.max_object_bytes
        rows = search.search(self.files, query, mode, case_sensitive, path, pathspecs, binary, context_lines, most)
        warnings = [f"{bytes(r['path'])!r} is too large ({r['size']} bytes)" for r in search.skipped(self.files, most, scope=path, pathspecs=pathspecs).limit(100).collect()]
        options = {"query": query, "mode": mode, "case": case_sensitive, "path": path, "pathspecs": sorted(pathspecs or []), "binary": binary, "context": context_lines, "most": most}
        return paging.page(rows, ["path", "ordinal"], "search", self.commit_oid, options, limit, cursor, limits, warnings)

    def _timed(self) -> DataFrame:
        return self.repository.commits.select("oid", F.col("committer.time").alias("time"))

    def log(self, order: str = "chronological", first_parent: bool = False, since: int | None = None, until: int | None = None, limit: int = 1000, cursor: str | None = None, limits: Limits | None = None) -> Page:
        options = {"order": order, "first": first_parent, "since": since, "until": until}
        goes_on = None
        if order == "chronological":
            at = (paging.position(cursor, "log", self.commit_oid, options) or [-1])[0] + 1
            rows, more = graph.log_part(self._timed(), self.repository.edges, self.commit_oid, "time", first_parent, since, until, limits, at)
            goes_on = [at + (limits or Limits()).max_objects - 1] if more else None
        else:
            rows = graph.log(self._timed(), self.repository.edges, self.commit_oid, "time", order, first_parent, since, until, limits)
        commits = self.repository.commits.select(F.col("oid").alias("o"), *[c for c in self.repository.commits.columns if c != "oid"])
        full = rows.join(commits, F.col("oid") == F.col("o")).drop("o")
        return paging.page(full, ["ordinal"], "log", self.commit_oid, options, limit, cursor, limits, goes_on=goes_on)

    def _states(self, paths: list[str]) -> DataFrame:
        """(commit, path, oid, mode) of paths in all commits that are reachable: one lookup a segment for all commits at once."""
        reach = graph.reachable(self.repository.edges, self.repository.spark.createDataFrame([(bytearray(self.commit_oid),)], "oid binary"))
        roots = self.repository.commits.join(reach, "oid", "left_semi").select(F.col("oid").alias("commit"), "tree_oid")
        entries = self.repository.tree_entries.select(F.col("tree_oid").alias("t"), "name", F.col("oid").alias("o"), F.col("mode").alias("m"))
        out = None
        for path in paths:
            now = roots.select("commit", F.col("tree_oid").alias("oid"), F.lit(0).alias("mode"))
            for part in path.encode().split(b"/"):
                now = now.join(entries.where(F.col("name") == F.lit(part)), F.col("oid") == F.col("t")).select("commit", F.col("o").alias("oid"), F.col("m").alias("mode"))
            one = now.where(F.col("mode").bitwiseAND(F.lit(O.FILE_TYPE)) != 0o040000).select("commit", F.lit(path).alias("path"), "oid", "mode")
            out = one if out is None else out.unionByName(one)
        return out

    def history(self, path: str, follow_renames: bool = True, limit: int = 1000, cursor: str | None = None, **refused: Any) -> Page:
        """The commits that change a path against their first parents, in chronological order; at an addition a rename goes on under the old path."""
        if refused:
            raise EngineError("invalid_argument", f"not for a history: {sorted(refused)}")
        rows = self._history(path, follow_renames)
        table = self.repository.spark.createDataFrame([(i, bytearray(c), p, a) for i, (p, c, a) in enumerate(rows)], "ordinal long, commit binary, path string, action string")
        return paging.page(table, ["ordinal"], "history", self.commit_oid, {"path": path, "follow": follow_renames}, limit, cursor)

    def _history(self, path: str, follow_renames: bool = True) -> list[tuple]:
        """(path, commit, action) of the whole history."""
        if not path:
            raise EngineError("invalid_path", "the root has no history")
        ranks = {bytes(r["oid"]): r["ordinal"] for r in graph.log(self._timed(), self.repository.edges, self.commit_oid, "time").collect()}
        first = {bytes(r["child"]): bytes(r["parent"]) for r in self.repository.edges.where("idx = 0").select("child", "parent").collect() if bytes(r["child"]) in ranks}

        def of(p: str, below: bytes | None) -> list[tuple]:
            rows = history.history(self._states([p]), self.repository.edges).select("commit", "action").collect()
            found = sorted(((ranks[bytes(r["commit"])], bytes(r["commit"]), r["action"]) for r in rows if bytes(r["commit"]) in ranks), key=lambda x: x[0])
            return [(c, a) for k, c, a in found if below is None or k > ranks[below]]

        def source(commit: bytes, p: str) -> str | None:
            if not follow_renames or commit not in first:
                return None
            old, new = (Snapshot(self.repository, c, bytes(self.repository.commits.where(F.col("oid") == F.lit(c)).first()["tree_oid"])) for c in (first[commit], commit))
            row = D.renames(D.summary(old.files, new.files), old.files, new.files).where((F.col("status") == "renamed") & (F.col("new_path") == F.lit(p.encode()))).first()
            return bytes(row["old_path"]).decode() if row else None

        return history.follow(of, source, path)

    def blame(self, path: str, lines: tuple[int, int] | None = None, follow_renames: bool = True) -> list[Any]:
        """Runs of lines with their origins, boundary flags and commits, in order of lines."""
        _, kind, _ = tree.resolve(self.repository.tree_entries, self.tree_oid, path)
        if kind != "blob":
            raise EngineError("invalid_argument", f"path_kind:{kind}")
        names = {path}
        if follow_renames:
            names |= {path_ for path_, _, _ in self._history(path)}
        states = self._states(sorted(names))
        # a commit that has several of the names counts with the latest one
        rank = F.element_at(F.create_map(*[x for i, n in enumerate([path, *sorted(names - {path})]) for x in (F.lit(n), F.lit(i))]), F.col("path"))
        one = states.groupBy("commit").agg(F.min_by(F.struct("path", "oid"), rank).alias("s")).select("commit", "s.path", F.col("s.oid").alias("o"))
        held = one.join(self.repository.objects.select("oid", "data"), F.col("o") == F.col("oid")).select("commit", "path", "data")
        parents = self.repository.edges.groupBy("child").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "parent"))), lambda x: O.format_oid(x["parent"])).alias("parents"))
        versions = held.join(parents, F.col("commit") == F.col("child"), "left").select(F.lit(path).alias("file"), O.format_oid(F.col("commit")).alias("commit"), "path", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "data")
        mine = history.blame(versions).where(F.col("commit") == self.commit_oid.hex())
        if lines is not None:
            n = mine.count()
            if lines[0] < 1 or lines[1] < lines[0] or lines[1] > n:
                raise EngineError("invalid_argument", "the range isn't within the file", line_count=n)
            mine = mine.where(F.col("line_no").between(*lines))
        edges = self.repository.edges.select(O.format_oid(F.col("child")).alias("child"))
        found = history.with_boundary(history.hunks(mine), edges)
        c = self.repository.commits.select(O.format_oid(F.col("oid")).alias("h"), "author", "committer", F.col("subject").alias("summary"))
        return found.join(c, F.col("origin_commit") == F.col("h"), "left").drop("h").orderBy("final_start").collect()

    def diff(self, head: Snapshot, format: str = "patch", pathspecs: list[str] | None = None, context_lines: int = 3, renames: bool = False, copies: bool = False, limits: Limits | None = None) -> dict[str, Any]:  # noqa: A002
        """What changes from this snapshot to head: files, and with "patch" their lines."""
        if copies:
            raise EngineError("unsupported_operation", "copies aren't looked for")
        if format not in D.FORMATS:
            raise EngineError("invalid_argument", f"unknown format {format!r}")
        limits = limits or Limits()
        if self.tree_oid == head.tree_oid:
            return {"files": [], "lines": [], "truncated": False}
        changes = D.summary(self.files, head.files, pathspecs)
        changes = D.renames(changes, self.files, head.files) if renames else changes.withColumn("similarity", F.lit(None).cast("int"))
        changes = spill(D.sort_path(changes).limit(limits.max_diff_files + 1))
        truncated = changes.count() > limits.max_diff_files
        shown = D.sort_path(changes).limit(limits.max_diff_files)
        listed = shown if format == "summary" else D.stats(shown, self.files, head.files, limits.max_object_bytes)
        lines = []
        if format == "patch":
            got = D.patch(shown, self.files, head.files, context_lines, limits.max_object_bytes)
            lines = got.orderBy(F.coalesce("new_path", "old_path"), "hunk", "at").limit(limits.max_diff_lines + 1).collect()
            if len(lines) > limits.max_diff_lines:
                lines, truncated = lines[: limits.max_diff_lines], True
            seen: dict = {}
            for i, r in enumerate(lines):
                if seen.setdefault((r["old_path"] and bytes(r["old_path"]), r["new_path"] and bytes(r["new_path"]), r["hunk"]), len(seen)) >= limits.max_diff_hunks:
                    lines, truncated = lines[:i], True
                    break
        return {"files": D.sort_path(listed).collect(), "lines": lines, "truncated": truncated}

    def submodules(self) -> list[Any]:
        declared = self.files.where((F.col("path") == F.lit(b".gitmodules")) & (F.col("kind") == "blob")).select(F.lit(0).alias("source"), "data")
        links = self.paths().where("kind = 'gitlink'").select("path", "oid")
        return submodules.correlate(submodules.declarations(declared).drop("source"), links).orderBy("path").collect()


def submit(runtime: Runtime, query: Callable[..., Any], *args: Any, owner: object = None, limits: Limits | None = None, **options: Any) -> Job:
    """Any query in the background, ended after the limits' timeout."""
    return runtime.submit(lambda: query(*args, **options), owner, (limits or Limits()).timeout_ms)
