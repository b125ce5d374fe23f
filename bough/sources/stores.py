"""Stores of objects that aren't files: fixed rows, and providers that answer batches of ids."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough import model
from bough.model import EngineError
from bough.sources.packs import object_id


def static(spark: SparkSession, objects: Iterable[tuple[str, bytes]], ids: Iterable[bytes] | None = None) -> DataFrame:
    """objects of (kind, data); with ids, each payload must have its id."""
    rows = [(bytearray(object_id(k, d)), k, len(d), bytearray(d)) for k, d in objects]
    if ids is not None:
        for (oid, *_), want in zip(rows, ids, strict=True):
            if bytes(oid) != want:
                raise EngineError("hash_mismatch", "an object doesn't have its id")
    return spark.createDataFrame(rows, model.OBJECTS)


class Backend(Protocol):
    """What answers requests for objects; it is sent to the executors, so it holds no connections."""

    def read_many(self, ids: list[bytes]) -> dict[bytes, tuple[str, bytes] | None]: ...


def provided(ids: DataFrame, backend: Backend, batch: int = 256, max_provider_bytes: int = 256 << 20) -> DataFrame:
    """(oid, kind, size, data) of the distinct ids (oid) that a provider has.

    Each request's answer must have exactly the ids asked for; an id that the provider
    lacks is None in it. Payloads are counted against the ceiling (for each task), then
    hashed.
    """

    def run(batches):
        total = 0
        for b in batches:
            asked = b.column("oid").to_pylist()
            for i in range(0, len(asked), batch):
                lot = asked[i : i + batch]
                answer = backend.read_many(lot)
                if set(answer) != set(lot):
                    raise EngineError("provider_protocol_error", "the answer has other ids than asked for")
                rows = []
                for oid in lot:
                    if answer[oid] is None:
                        continue
                    kind, data = answer[oid]
                    total += len(data)
                    if total > max_provider_bytes:
                        raise EngineError("budget_exceeded", "max_provider_bytes")
                    if object_id(kind, data) != oid:
                        raise EngineError("hash_mismatch", "the provider's payload doesn't have its id")
                    rows.append((oid, kind, len(data), data))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.int64(), pa.binary()))], ["oid", "kind", "size", "data"])

    return ids.select("oid").distinct().where(F.col("oid").isNotNull()).mapInArrow(run, model.OBJECTS)
