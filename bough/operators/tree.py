"""Trees: expansion of stored entries into paths, listings, resolution of paths.

Listings come in stored order, in which a directory compares as if a slash followed
its name; ``sort_key`` is that key, for ordering and for paging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.functions import octets as O
from bough.functions import pathspec
from bough.model import EngineError

KINDS = ("blob", "tree", "symlink", "gitlink")
DEEPEST = 4096


def expand(entries: DataFrame, root: bytes, depth: int | None = None, pathspecs: list[str] | None = None, scope: str = "") -> DataFrame:
    """(path, sort_key, depth, mode, kind, oid) of everything under the tree ``root``.

    One join a level, of the level's directories with the stored entries; directories
    that can't hold a match of the pathspecs aren't entered. Each level is written to
    the checkpoint folder, so the plan stays short and a lost executor costs one level.
    """
    from bough.plans.stages import spill

    if root is None:
        raise EngineError("not_found", "there is no such tree")
    spark = entries.sparkSession
    stored = entries.select(F.col("tree_oid").alias("t"), "mode", "name", F.col("oid").alias("o"), F.col("kind").alias("k"))
    level = spark.createDataFrame([(bytearray(root), "")], "oid binary, prefix string")
    out = None
    for n in range(1, min(depth, DEEPEST) + 1 if depth is not None else DEEPEST):
        name = O.chars(F.col("name"))
        here = level.join(stored, level["oid"] == stored["t"]).select(F.when(F.col("prefix") == "", name).otherwise(F.concat("prefix", F.lit("/"), name)).alias("p"), F.lit(n).alias("depth"), "mode", F.col("k").alias("kind"), F.col("o").alias("oid"))
        here = spill(here)
        out = here if out is None else out.unionByName(here)
        level = here.where(here["kind"] == "tree")
        if pathspecs:
            level = level.where(pathspec.may_hold(F.col("p"), [f"{scope}/{s}" if scope else s for s in pathspecs]))
        level = level.select("oid", F.col("p").alias("prefix"))
        if level.isEmpty():
            break
    if out is None:
        out = level.select(F.col("prefix").alias("p"), F.lit(0).alias("depth"), F.lit(0).alias("mode"), F.lit("").alias("kind"), "oid").limit(0)
    path = O.octets(F.col("p"))
    return out.select(path.alias("path"), O.sort_key(path, F.col("kind")).alias("sort_key"), "depth", "mode", "kind", "oid")


def listing(paths: DataFrame, scope: str = "", recursive: bool = False, depth: int | None = None, types: tuple[str, ...] = KINDS, pathspecs: list[str] | None = None) -> DataFrame:
    """The entries under the directory ``scope``, with sort_key, depths counted from it and pathspecs relative to it."""
    if unknown := set(types) - set(KINDS):
        raise EngineError("invalid_argument", f"unknown types: {sorted(unknown)}")
    if depth is not None and depth < 0:
        raise EngineError("invalid_argument", "depth can't be negative")
    text = O.chars(F.col("path"))
    levels = scope.count("/") + 1 if scope else 0
    most = depth if depth is not None else None if recursive else 1
    out = paths.withColumn("sort_key", O.sort_key(F.col("path"), F.col("kind"))).where(F.col("kind").isin(*types))
    if scope:
        under = scope.encode().decode("latin-1") + "/"
        out = out.where(text.startswith(under))
        text = F.substr(text, F.lit(len(under) + 1))
    out = out.withColumn("depth", F.size(F.split(O.chars(F.col("path")), "/")) - levels)
    if most is not None:
        out = out.where(F.col("depth") <= most)
    return out.where(pathspec.matches(text, pathspecs or []))


def resolve(entries: DataFrame, root: bytes, path: str | bytes) -> tuple[int, str, bytes]:
    """(mode, kind, oid) at a path, one lookup for each of its segments; the empty path is the root."""
    raw = path.encode() if isinstance(path, str) else path
    now = (0o040000, "tree", bytes(root))
    if not raw:
        return now
    parts = raw.split(b"/")
    if b"\0" in raw or any(p in (b"", b".", b"..") for p in parts):
        raise EngineError("invalid_path", "the path isn't canonical")
    for part in parts:
        if now[1] != "tree":
            raise EngineError("invalid_path", "a segment of the path isn't a directory")
        row = entries.where((F.col("tree_oid") == F.lit(now[2])) & (F.col("name") == F.lit(part))).select("mode", "kind", "oid").first()
        if row is None:
            raise EngineError("invalid_path", "there is no such path")
        now = (row["mode"], row["kind"], bytes(row["oid"]))
    return now
