"""References of a repository's folder: loose files, packed ones, the shallow list."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from bough import model
from bough.operators.refs import overlay

_OID = re.compile(rb"[0-9a-f]{40}|[0-9a-f]{64}")


def _one(name: bytes, data: bytes) -> tuple | None:
    data = data.strip()
    if data.startswith(b"ref:"):
        return bytearray(name), "symbolic", None, bytearray(data[4:].strip()), None
    return (bytearray(name), "direct", bytearray.fromhex(data.decode()), None, None) if _OID.fullmatch(data) else None


def loose(spark: SparkSession, folder: str) -> DataFrame:
    """Loose references and HEAD; broken files are passed over."""
    rows = []
    names = [b"HEAD"] if os.path.isfile(os.path.join(folder, "HEAD")) else []
    root = os.fsencode(folder)
    for at, _, files in os.walk(os.path.join(root, b"refs")):
        names += [os.path.relpath(os.path.join(at, f), root) for f in files]
    for name in names:
        with open(os.path.join(root, name), "rb") as f:
            if (row := _one(name, f.read(8192))) is not None:
                rows.append(row)
    return spark.createDataFrame(rows, model.REFS)


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """Packed references with the peeled ids recorded behind them."""
    rows: list[list] = []
    path = os.path.join(folder, "packed-refs")
    if os.path.isfile(path):
        with open(path, "rb") as f:
            for line in f.read().split(b"\n"):
                if line.startswith(b"^") and rows and _OID.fullmatch(line[1:]):
                    rows[-1][4] = bytearray.fromhex(line[1:].decode())
                elif line and not line.startswith(b"#"):
                    oid, _, name = line.partition(b" ")
                    if name and _OID.fullmatch(oid):
                        rows.append([bytearray(name), "direct", bytearray.fromhex(oid.decode()), None, None])
    return spark.createDataFrame([tuple(r) for r in rows], model.REFS)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return overlay(loose(spark, folder), packed(spark, folder))


def shallow(spark: SparkSession, folder: str) -> DataFrame:
    """(oid) of the commits at a shallow boundary."""
    path, rows = os.path.join(folder, "shallow"), []
    if os.path.isfile(path):
        with open(path, "rb") as f:
            rows = [(bytearray.fromhex(x.decode()),) for x in f.read().split(b"\n") if _OID.fullmatch(x)]
    return spark.createDataFrame(rows, "oid binary")
