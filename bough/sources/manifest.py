"""Manifests of packs: what a hydration has to fetch, and how a manifest is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of the manifest that aren't present (id, pack_size, index_size) with both sizes."""
    return manifest.join(present, ["id", "pack_size", "index_size"], "left_anti")


def windows(manifest: DataFrame, size: int = 8 << 20) -> DataFrame:
    """(key, offset, length): byte ranges of at most ``size`` that cover every artifact, one task's work each."""
    both = manifest.select(F.explode(F.array(F.struct(F.col("pack_key").alias("key"), F.col("pack_size").alias("n")), F.struct(F.col("index_key").alias("key"), F.col("index_size").alias("n")))).alias("a")).select("a.*").where("n > 0")
    each = both.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("offset"))
    return each.select("key", "offset", F.least(F.lit(size).cast("long"), F.col("n") - F.col("offset")).alias("length"))


def inventory(files: DataFrame) -> DataFrame:
    """(name, path, size) of packs (path, size) over all alternates, one for each basename (the first path), by name."""
    name = F.element_at(F.split("path", "/"), -1)
    packs = files.where(F.col("path").rlike(r"(^|/)pack-[0-9a-f]{40}([0-9a-f]{24})?\.pack$")).select(name.alias("name"), "path", "size")
    best = packs.groupBy("name").agg(F.min(F.struct("path", "size")).alias("b"))
    return best.select("name", F.col("b.path").alias("path"), F.col("b.size").alias("size")).orderBy("name")
