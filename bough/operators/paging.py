"""Bounded pages of ordered results.

A page is one sorted and limited read (TakeOrderedAndProject): limit + 1 rows come to
the driver. Its cursor holds the last row's key; the next page is a keyset predicate
on it, not a replay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from bough.functions import cursor as C
from bough.model import EngineError, Limits, Page


def after(keys: list[Column], position: list) -> Column:
    """Rows behind a position, in ascending order of the keys."""
    out = F.lit(False)
    for i in reversed(range(len(keys))):
        here = keys[i] > F.lit(position[i])
        out = here | ((keys[i] == F.lit(position[i])) & out) if i < len(keys) - 1 else here
    return out


def _pack(values: list) -> bytes:
    return json.dumps([{"b": bytes(v).hex()} if isinstance(v, bytes | bytearray) else v for v in values], separators=(",", ":")).encode()


def _unpack(position: bytes) -> list:
    return [bytes.fromhex(v["b"]) if isinstance(v, dict) else v for v in json.loads(position)]


def _size(row: Row) -> int:
    def one(v) -> int:
        if isinstance(v, bytes | bytearray | str):
            return len(v)
        if isinstance(v, list | tuple):
            return sum(map(one, v))
        return 8

    return sum(map(one, row))


def position(cursor: str | None, operation: str, snapshot: bytes, options: dict) -> list | None:
    """The key that a cursor holds."""
    return None if cursor is None else _unpack(C.decode(cursor, snapshot, operation, C.fingerprint(options)).position)


def page(df: DataFrame, keys: list[str], operation: str, snapshot: bytes, options: dict, limit: int = 1000, cursor: str | None = None, limits: Limits | None = None, warnings: list[str] | None = None, goes_on: list | None = None) -> Page:
    """The rows behind the cursor, at most limit of them and about max_result_bytes; one row at least if there is any.

    goes_on: where df itself ends early, by max_objects, the key at which it does.
    """
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise TypeError("limit is an integer")
    if limit < 1:
        raise EngineError("invalid_argument", "limit must be positive")
    limits = limits or Limits()
    most = min(limit, limits.max_results)
    mark = C.fingerprint(options)
    if cursor is not None:
        df = df.where(after([F.col(k) for k in keys], _unpack(C.decode(cursor, snapshot, operation, mark).position)))
    rows = df.orderBy(*keys).limit(most + 1).collect()
    items, total, stopped = [], 0, None
    for r in rows:
        if len(items) == most:
            stopped = "limit" if limit <= limits.max_results else "max_results"
            break
        total += _size(r)
        if items and total > limits.max_result_bytes:
            stopped = "max_result_bytes"
            break
        items.append(r)
    last = [items[-1][k] for k in keys] if stopped else goes_on
    stopped = stopped or ("max_objects" if goes_on else None)
    next_ = C.Cursor(snapshot, operation, mark, _pack(last)).encode() if stopped else None
    return Page(items, next_, stopped is not None, {"entries_emitted": len(items), "result_bytes": min(total, limits.max_result_bytes), "stopped_by": stopped}, warnings or [])


def within_bytes(df: DataFrame, size: Column, keys: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """The first rows whose sizes stay within ``most`` together (for each value of ``by``); the very first always."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__upto", F.sum(size).over(w)).withColumn("__n", F.count(F.lit(1)).over(w)).where((F.col("__upto") <= most) | (F.col("__n") == 1)).drop("__upto", "__n")
