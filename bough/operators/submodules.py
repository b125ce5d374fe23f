"""Declared submodules and the gitlinks that snapshots hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bough.functions import config


def declarations(files: DataFrame) -> DataFrame:
    """(source, name, path, url, branch) out of configuration files (source, data)."""

    def run(batches):
        for batch in batches:
            out = [(s, d["name"], d["path"], d["url"], d["branch"]) for s, data in zip(batch.column("source").to_pylist(), batch.column("data").to_pylist(), strict=True) for d in config.declarations(data or b"")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("source").type), *(pa.array([o[i] for o in out], pa.binary()) for i in range(1, 5))], ["source", "name", "path", "url", "branch"])

    kind = files.schema["source"].dataType.simpleString()
    return files.select("source", "data").mapInArrow(run, f"source {kind}, name binary, path binary, url binary, branch binary")


def correlate(declared: DataFrame, gitlinks: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, path, url, branch, commit_oid, status): declarations (name, path, url, branch) against gitlinks (path, oid).

    Of several declarations of one path the first by name has the gitlink (active);
    the others, like those of a path without one, are orphaned. Gitlinks that nobody
    declared are undeclared.
    """
    w = Window.partitionBy("path").orderBy(F.col("name") if name is None else name)
    d = declared.withColumn("claim", F.row_number().over(w)).withColumnRenamed("path", "declared")
    g = gitlinks.select(F.col("path").alias("linked"), F.col("oid").alias("commit_oid"))
    both = d.join(g, (F.col("declared") == F.col("linked")) & (F.col("claim") == 1), "full_outer")
    status = F.when(F.col("declared").isNull(), "undeclared").when(F.col("linked").isNull(), "orphaned").otherwise("active")
    return both.select("name", F.coalesce("declared", "linked").alias("path"), "url", "branch", "commit_oid", status.alias("status"))
