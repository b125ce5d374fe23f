"""Decoding of stored objects (oid, kind, size, data) into relations, on executors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bough import model
from bough.functions import decode


def _decoded(objects: DataFrame, kind: str, schema: str, each) -> DataFrame:
    fields = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else schema
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            rows = [r for oid, data in zip(batch.column("oid").to_pylist(), batch.column("data").to_pylist(), strict=True) for r in each(oid, data)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return objects.where(F.col("kind") == kind).select("oid", "data").mapInArrow(run, fields)


def commits(objects: DataFrame) -> DataFrame:
    return _decoded(objects, "commit", model.COMMITS, lambda oid, data: [{"oid": oid, **decode.commit(data)}])


def commit_edges(commits_: DataFrame) -> DataFrame:
    """(child, parent, idx) in encoded order; a parent named twice is followed once."""
    each = commits_.select(F.col("oid").alias("child"), F.posexplode("parents").alias("idx", "parent"))
    return each.groupBy("child", "parent").agg(F.min("idx").alias("idx"))


def tags(objects: DataFrame) -> DataFrame:
    return _decoded(objects, "tag", model.TAGS, lambda oid, data: [{"oid": oid, **decode.tag(data)}])


def tree_entries(objects: DataFrame, digest: int = 20) -> DataFrame:
    def each(oid: bytes, data: bytes) -> list[dict]:
        return [{"tree_oid": oid, "ordinal": i, "mode": m, "name": n, "oid": o, "kind": k} for i, (m, n, o, k) in enumerate(decode.tree(data, digest))]

    return _decoded(objects, "tree", model.TREE_ENTRIES, each)
