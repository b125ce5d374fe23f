"""A whole repository in one file: packs, their indexes, references, metadata.

Layout: header (magic, major, minor, zeros), the files' bytes without gaps, a table of
contents, a trailer (offset, length and SHA-256 of the table, zeros, magic). Integers
are little-endian; byte strings have a length of 32 bits before them. Equal content
gives equal files. A file appears by renaming and its generation grows with each.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from bough import model
from bough.model import EngineError
from bough.sources import packs

MAGIC = b"BOUGHPK\0"
MAJOR, MOST_TABLE = 1, 64 << 20
_KINDS = {"commit": 1, "tag": 2, "tree": 3, "blob": 4}
_NAMES = {v: k for k, v in _KINDS.items()}
_FILE = re.compile(r"pack-[0-9a-f]{40}\.(pack|idx)")


@dataclass
class Bundle:
    path: str
    generation: int
    metadata: dict[str, str]
    files: list[tuple[int, str, int, int, bytes]]  # kind, name, offset, length, sha256
    refs: list[tuple[bytes, bytes, str, bytes | None]]  # name, target, kind, peeled
    size: int = field(default=0)

    def refs_table(self, spark: SparkSession) -> DataFrame:
        rows = [(bytearray(n), "direct", bytearray(t), None, bytearray(p) if p is not None else None) for n, t, _, p in self.refs]
        return spark.createDataFrame(rows, model.REFS)

    def objects(self, spark: SparkSession) -> DataFrame:
        """objects, a task for each pack, read from its range of the file."""
        path, mine = self.path, [(n, o, s) for k, n, o, s, _ in self.files if k == 1]
        if not mine:
            return spark.createDataFrame([], model.OBJECTS)

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    with open(path, "rb") as f:
                        f.seek(r["offset"])
                        raw = f.read(r["length"])
                    yield from packs._lots(packs.read_pack(raw))

        return spark.createDataFrame(mine, "name string, offset long, length long").repartition(len(mine), "name").mapInArrow(run, model.OBJECTS).dropDuplicates(["oid"])


def _bytes(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def write(path: str, folder: str, refs: list[tuple[bytes, bytes, str, bytes | None]], metadata: dict[str, str], generation: int | None = None) -> Bundle:
    """A bundle of the packs in a folder. Metadata needs source_identity; the generation must exceed that of the file it replaces."""
    if "source_identity" not in metadata:
        raise EngineError("invalid_argument", "metadata needs source_identity")
    if "shallow_roots" in metadata or os.path.exists(os.path.join(os.path.dirname(folder.rstrip("/")), "shallow")):
        raise EngineError("unsupported_operation", "shallow sources can't be bundled")
    before = open_bundle(path).generation if os.path.exists(path) else 0
    generation = before + 1 if generation is None else generation
    if generation <= before:
        raise EngineError("conflict", "the generation doesn't exceed the present one")
    names = sorted(x[: -len(".pack")] for x in os.listdir(folder) if x.endswith(".pack"))
    order = sorted(set(refs), key=lambda r: r[0])
    if len({r[0] for r in order}) < len(order):
        raise EngineError("malformed_ref", "a reference occurs twice")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as out:
            out.write(MAGIC + struct.pack("<HHI", MAJOR, 0, 0))
            at, files = 16, []
            for name in names:
                for kind, suffix in ((1, ".pack"), (2, ".idx")):
                    digest, size = hashlib.sha256(), 0
                    with open(os.path.join(folder, name + suffix), "rb") as f:
                        while part := f.read(8 << 20):
                            digest.update(part)
                            out.write(part)
                            size += len(part)
                    files.append((kind, name + suffix, at, size, digest.digest()))
                    at += size
            table = struct.pack("<BQI", 1, generation, len(metadata))
            for k, v in sorted(metadata.items(), key=lambda x: x[0].encode()):
                table += _bytes(k.encode()) + _bytes(v.encode())
            table += struct.pack("<I", len(files))
            for kind, name, offset, size, digest_ in files:
                table += bytes([kind]) + _bytes(name.encode()) + struct.pack("<QQ", offset, size) + digest_
            table += struct.pack("<I", len(order))
            for name, target, kind, peeled in order:
                table += _bytes(name) + target + bytes([_KINDS[kind], peeled is not None]) + (peeled or b"")
            if len(table) > MOST_TABLE:
                raise EngineError("unsupported_operation", "the table of contents exceeds 64 MiB")
            out.write(table + struct.pack("<QQ", at, len(table)) + hashlib.sha256(table).digest() + bytes(8) + MAGIC)
            out.flush()
            os.fsync(out.fileno())
        os.rename(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return open_bundle(path)


def _bad(what: str) -> EngineError:
    return EngineError("malformed_bundle", what)


class _Table:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _bad("the table of contents is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def string(self, least: int, most: int) -> bytes:
        n = self.number("I")
        if not least <= n <= most:
            raise _bad("length of a string")
        return self.take(n)

    def text(self, least: int, most: int) -> str:
        try:
            return self.string(least, most).decode()
        except UnicodeDecodeError as e:
            raise _bad("text isn't UTF-8") from e


def open_bundle(path: str) -> Bundle:
    """The contents by header, trailer and table alone; the table's digest is checked."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(16)
        if head[:8] != MAGIC:
            raise EngineError("invalid_argument", "not a bundle")
        if len(head) < 16 or size < 80:
            raise _bad("shorter than a header and a trailer")
        major, _, zero = struct.unpack("<HHI", head[8:])
        if major > MAJOR:
            raise EngineError("unsupported_operation", f"version {major}; this reads up to {MAJOR}")
        if major == 0 or zero:
            raise _bad("header")
        f.seek(size - 64)
        tail = f.read(64)
        at, n = struct.unpack("<QQ", tail[:16])
        if tail[56:] != MAGIC or tail[48:56] != bytes(8) or at < 16 or at + n + 64 != size or n > MOST_TABLE:
            raise _bad("trailer")
        f.seek(at)
        table = f.read(n)
    if hashlib.sha256(table).digest() != tail[16:48]:
        raise _bad("digest of the table of contents")
    t = _Table(table)
    if t.number("B") != 1:
        raise _bad("hash algorithm")
    generation = t.number("Q")
    if generation < 1:
        raise _bad("generation")
    metadata: dict[str, str] = {}
    last = None
    for _ in range(t.number("I")):
        key = t.text(1, 4096)
        if last is not None and key.encode() <= last:
            raise _bad("order of the metadata")
        last = key.encode()
        metadata[key] = t.text(0, 65536)
    if "shallow_roots" in metadata:
        raise EngineError("unsupported_operation", "shallow_roots")
    if "source_identity" not in metadata:
        raise _bad("source_identity is missing")
    files, end, stem = [], 16, None
    for _ in range(t.number("I")):
        kind, name, offset, length = t.number("B"), t.text(1, 4096), t.number("Q"), t.number("Q")
        digest = t.take(32)
        if offset != end or length < 1 or offset + length > at:
            raise _bad(f"range of {name}")
        end = offset + length
        if name in (x[1] for x in files):
            raise _bad(f"{name} occurs twice")
        if kind in (1, 2):
            if not _FILE.fullmatch(name) or name.endswith(".idx") != (kind == 2) or (stem is None) != (kind == 1) or (kind == 2 and name[:-4] != stem):
                raise _bad(f"pairing of {name}")
            stem = name[:-5] if kind == 1 else None
        files.append((kind, name, offset, length, digest))
    if end != at or stem is not None:
        raise _bad("the files don't fill their part")
    refs, last = [], None
    for _ in range(t.number("I")):
        name, target, kind, flag = t.string(1, 4096), t.take(20), t.number("B"), t.number("B")
        if kind not in _NAMES or flag > 1 or last is not None and name <= last:
            raise _bad("references")
        last = name
        refs.append((name, target, _NAMES[kind], t.take(20) if flag else None))
    return Bundle(path, generation, metadata, files, refs, size)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok): every file's digest computed anew, a task each."""
    import pyarrow as pa

    b = open_bundle(path)

    def run(batches):
        for batch in batches:
            ok = []
            for r in batch.to_pylist():
                digest, left = hashlib.sha256(), r["length"]
                with open(path, "rb") as f:
                    f.seek(r["offset"])
                    while left and (part := f.read(min(left, 8 << 20))):
                        digest.update(part)
                        left -= len(part)
                ok.append(digest.digest() == r["digest"])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(ok)], ["name", "ok"])

    rows = spark.createDataFrame([(n, o, s, bytearray(d)) for _, n, o, s, d in b.files], "name string, offset long, length long, digest binary")
    return rows.repartition(max(1, len(b.files)), "name").mapInArrow(run, "name string, ok boolean")


def info(path: str) -> dict:
    b = open_bundle(path)
    return {"generation": b.generation, "metadata": b.metadata, "files": [(n, s) for _, n, _, s, _ in b.files], "refs": len(b.refs), "size": b.size}


def extract(path: str, folder: str) -> list[str]:
    """Write the bundle's packs and indexes into a folder, verified; returns the names of the packs."""
    b = open_bundle(path)
    os.makedirs(folder, exist_ok=True)
    held: dict[str, bytes] = {}
    with open(path, "rb") as f:
        for kind, name, offset, length, digest in b.files:
            f.seek(offset)
            data = f.read(length)
            if hashlib.sha256(data).digest() != digest:
                raise _bad(f"digest of {name}")
            if kind == 1:
                held["pack"] = data
            elif kind == 2:
                packs.verify_pair(held["pack"], data)
                packs.publish(os.path.join(folder, name[:-4] + ".pack"), held["pack"])
                packs.publish(os.path.join(folder, name), data)
    return [n[:-5] for k, n, *_ in b.files if k == 1]
