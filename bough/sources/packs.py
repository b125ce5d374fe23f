"""Packs and loose objects: reading them into ``objects`` and writing packs, one task a pack."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough import model
from bough.model import EngineError

_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_CODES = {v: k for k, v in _TYPES.items()}
PACK_NAME = re.compile(r"pack-[0-9a-f]{40}\.pack")


def object_id(kind: str, data: bytes) -> bytes:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(data)) + data).digest()


def _patch(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base."""
    at = 0

    def size() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = delta[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    try:
        if size() != len(base):
            raise EngineError("malformed_object", "a delta is of another base")
        want, out = size(), bytearray()
        while at < len(delta):
            c = delta[at]
            at += 1
            if c & 128:
                offset = length = 0
                for k in range(7):
                    if c >> k & 1:
                        if k < 4:
                            offset |= delta[at] << 8 * k
                        else:
                            length |= delta[at] << 8 * (k - 4)
                        at += 1
                length = length or 0x10000
                if offset + length > len(base):
                    raise EngineError("malformed_object", "a delta copies from behind its base")
                out += base[offset : offset + length]
            elif c:
                out += delta[at : at + c]
                at += c
            else:
                raise EngineError("malformed_object", "reserved instruction in a delta")
    except IndexError as e:
        raise EngineError("malformed_object", "a delta is cut off") from e
    if len(out) != want:
        raise EngineError("malformed_object", "a delta makes another length than it says")
    return bytes(out)


def read_pack(raw: bytes) -> Iterator[tuple[bytes, str, bytes]]:
    """(oid, kind, data) of every object of a complete pack, deltas resolved."""
    if len(raw) < 32 or hashlib.sha1(raw[:-20]).digest() != raw[-20:]:
        raise EngineError("pack_checksum_mismatch", "the pack's trailer doesn't fit its content")
    magic, version, count = struct.unpack(">4sII", raw[:12])
    if magic != b"PACK" or version not in (2, 3):
        raise EngineError("malformed_object", "not a pack")
    at, by_offset, by_oid, waiting = 12, {}, {}, []
    for _ in range(count):
        begin = at
        c = raw[at]
        at += 1
        kind, size, shift = c >> 4 & 7, c & 15, 4
        while c & 128:
            c = raw[at]
            at += 1
            size |= (c & 127) << shift
            shift += 7
        base: int | bytes | None = None
        if kind == 6:
            c = raw[at]
            at += 1
            back = c & 127
            while c & 128:
                c = raw[at]
                at += 1
                back = (back + 1 << 7) | (c & 127)
            base = begin - back
        elif kind == 7:
            base = raw[at : at + 20]
            at += 20
        elif kind not in _TYPES:
            raise EngineError("malformed_object", "unknown type of an entry")
        try:
            z = zlib.decompressobj()
            data = z.decompress(raw[at:-20] if len(raw) - at < 1 << 16 else raw[at : at + size + (size >> 3) + 4096])
            while not z.eof:
                raise zlib.error("cut off")
        except zlib.error:
            z = zlib.decompressobj()
            try:
                data = z.decompress(raw[at:-20])
            except zlib.error as e:
                raise EngineError("malformed_object", "an entry can't be inflated") from e
            fed = len(raw) - 20 - at
        else:
            fed = len(raw[at:-20]) if len(raw) - at < 1 << 16 else min(len(raw) - at, size + (size >> 3) + 4096)
        if not z.eof or len(data) != size:
            raise EngineError("malformed_object", "an entry has another size than it says")
        at += fed - len(z.unused_data)
        if base is None:
            name = _TYPES[kind]
            oid = object_id(name, data)
            by_offset[begin] = by_oid[oid] = (name, data)
            yield oid, name, data
        else:
            waiting.append((begin, base, data))
    while waiting:
        later = []
        for begin, base, delta in waiting:
            found = by_offset.get(base) if isinstance(base, int) else by_oid.get(bytes(base))
            if found is None:
                later.append((begin, base, delta))
                continue
            name, data = found[0], _patch(found[1], delta)
            oid = object_id(name, data)
            by_offset[begin] = by_oid[oid] = (name, data)
            yield oid, name, data
        if len(later) == len(waiting):
            raise EngineError("missing_object", "a delta's base isn't in the pack")
        waiting = later


def write_pack(objects: list[tuple[bytes, str, bytes]]) -> tuple[bytes, bytes]:
    """(pack, index) of (oid, kind, data), in order of id; the same objects give the same bytes."""
    out, entries = bytearray(struct.pack(">4sII", b"PACK", 2, len(objects))), []
    for oid, kind, data in sorted(objects):
        begin, size = len(out), len(data)
        head = bytearray([_CODES[kind] << 4 | size & 15])
        size >>= 4
        while size:
            head[-1] |= 128
            head.append(size & 127)
            size >>= 7
        body = bytes(head) + zlib.compress(data, 6)
        entries.append((oid, zlib.crc32(body), begin))
        out += body
    pack = bytes(out) + hashlib.sha1(out).digest()
    return pack, write_index(entries, pack[-20:])


def write_index(entries: list[tuple[bytes, int, int]], pack_checksum: bytes) -> bytes:
    counts = [0] * 256
    for oid, _, _ in entries:
        counts[oid[0]] += 1
    fan, total = [], 0
    for c in counts:
        total += c
        fan.append(total)
    large = [o for _, _, o in entries if o >= 1 << 31]
    index = {o: i for i, o in enumerate(large)}
    body = b"\xfftOc" + struct.pack(">I256I", 2, *fan) + b"".join(e[0] for e in entries) + b"".join(struct.pack(">I", e[1]) for e in entries)
    body += b"".join(struct.pack(">I", o if o < 1 << 31 else 1 << 31 | index[o]) for _, _, o in entries) + b"".join(struct.pack(">Q", o) for o in large) + pack_checksum
    return body + hashlib.sha1(body).digest()


def read_index(raw: bytes) -> tuple[list[tuple[bytes, int, int]], bytes]:
    """Entries (oid, crc, offset) and the checksum of the pack of a version 2 index."""
    if len(raw) < 1072 or hashlib.sha1(raw[:-20]).digest() != raw[-20:]:
        raise EngineError("index_checksum_mismatch", "the index's trailer doesn't fit its content")
    if raw[:8] != b"\xfftOc\0\0\0\2":
        raise EngineError("malformed_object", "not an index of version 2")
    n = struct.unpack(">I", raw[1028:1032])[0]
    at = 1032
    oids = [raw[at + 20 * i : at + 20 * i + 20] for i in range(n)]
    at += 20 * n
    crcs = struct.unpack(f">{n}I", raw[at : at + 4 * n])
    at += 4 * n
    offsets = struct.unpack(f">{n}I", raw[at : at + 4 * n])
    at += 4 * n
    wide = [struct.unpack(">Q", raw[at + 8 * (o & 0x7FFFFFFF) : at + 8 * (o & 0x7FFFFFFF) + 8])[0] if o >> 31 else o for o in offsets]
    return list(zip(oids, crcs, wide, strict=True)), raw[-40:-20]


def verify_pair(pack: bytes, index: bytes) -> int:
    """Number of objects, if both checksums are right and the index is this pack's."""
    if len(pack) < 32 or hashlib.sha1(pack[:-20]).digest() != pack[-20:]:
        raise EngineError("pack_checksum_mismatch", "the pack's trailer doesn't fit its content")
    entries, checksum = read_index(index)
    if checksum != pack[-20:]:
        raise EngineError("index_checksum_mismatch", "the index belongs to another pack")
    if struct.unpack(">I", pack[8:12])[0] != len(entries):
        raise EngineError("index_checksum_mismatch", "pack and index count different objects")
    return len(entries)


def read_loose(raw: bytes) -> tuple[str, bytes]:
    """(kind, data) of a loose object."""
    try:
        whole = zlib.decompress(raw)
    except zlib.error as e:
        raise EngineError("malformed_object", "a loose object can't be inflated") from e
    m = re.match(rb"(commit|tree|blob|tag) (\d+)\0", whole)
    if not m or int(m[2]) != len(whole) - m.end():
        raise EngineError("malformed_object", "header of a loose object")
    return m[1].decode(), whole[m.end() :]


def _objects(rows: list[tuple[bytes, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["oid", "kind", "size", "data"])


def _lots(rows: Iterator[tuple[bytes, str, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    lot, size = [], 0
    for r in rows:
        lot.append(r)
        size += len(r[2])
        if size >= most:
            yield _objects(lot)
            lot, size = [], 0
    if lot:
        yield _objects(lot)


def alternates(objects_dir: str, depth: int = 5) -> list[str]:
    """A directory of objects and those it borrows from, transitively."""
    out, todo = [], [(objects_dir, 0)]
    while todo:
        here, n = todo.pop(0)
        if here in out or n > depth:
            continue
        out.append(here)
        listed = os.path.join(here, "info", "alternates")
        if os.path.isfile(listed):
            with open(listed) as f:
                todo += [(os.path.normpath(os.path.join(here, x.strip())), n + 1) for x in f if x.strip() and not x.startswith("#")]
    return out


def read_store(spark: SparkSession, objects_dir: str) -> DataFrame:
    """objects of a repository's directory of objects: loose ones, packs and alternates; each id once, every payload hashed.

    A task reads whole files; a pack is one row of the binaryFile source.
    """
    frames = []
    for folder in alternates(objects_dir):
        for pattern, glob in (("loose", "[0-9a-f][0-9a-f]/*"), ("pack", "pack/*.pack")):
            import glob as g

            if g.glob(os.path.join(folder, glob)):
                files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(os.path.join(folder, glob))
                frames.append(files.select("path", "content", F.lit(pattern).alias("how")))
    if not frames:
        return spark.createDataFrame([], model.OBJECTS)
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)

    def run(batches):
        for batch in batches:
            for path, raw, how in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "how")), strict=True):
                if how == "pack":
                    yield from _lots(read_pack(raw))
                    continue
                kind, data = read_loose(raw)
                oid = object_id(kind, data)
                if oid.hex() != "".join(path.rstrip("/").rsplit("/", 2)[-2:]):
                    raise EngineError("hash_mismatch", "a loose object doesn't have its id")
                yield _objects([(oid, kind, data)])

    return union.mapInArrow(run, model.OBJECTS).dropDuplicates(["oid"])


def write_loose(objects_dir: str, kind: str, data: bytes) -> bytes:
    oid = object_id(kind, data)
    name = oid.hex()
    os.makedirs(os.path.join(objects_dir, name[:2]), exist_ok=True)
    publish(os.path.join(objects_dir, name[:2], name[2:]), zlib.compress(b"%s %d\0" % (kind.encode(), len(data)) + data))
    return oid


def publish(path: str, data: bytes) -> None:
    """Write a file as a whole or not at all."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.rename(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def publish_packs(objects: DataFrame, folder: str, packs: int = 8) -> DataFrame:
    """Write objects as packs into a folder that all executors share; returns the manifest, which is to be written last.

    Names come from content, and files appear by renaming, so a task that runs twice
    does no harm.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("oid", "kind", "data")), strict=True)]
        if not rows:
            return
        pack, index = write_pack(rows)
        name = f"pack-{pack[-20:].hex()}"
        publish(os.path.join(folder, name + ".pack"), pack)
        publish(os.path.join(folder, name + ".idx"), index)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, name + ".pack", name + ".idx", len(pack), len(index), pack[-20:].hex())], ["id", "pack_key", "index_key", "pack_size", "index_size", "etag"])

    return objects.select("oid", "kind", "data").repartition(packs, "oid").mapInArrow(run, model.MANIFEST)


def sound(pack: str, index: str) -> bool:
    """Whether two files are a pack and its index, by their checksums."""
    try:
        with open(pack, "rb") as a, open(index, "rb") as b:
            verify_pair(a.read(), b.read())
    except EngineError:
        return False
    return True


def hydrate(manifest: DataFrame, read_range, folder: str, window: int = 8 << 20) -> DataFrame:
    """Fetch the packs of a manifest that the folder lacks, a task each: in ranges of ``window`` bytes by read_range(key, offset, length), verified as pairs, then renamed into place.

    Returns (id, status, bytes, requests); status is present, for a pair of files whose
    sizes and checksums are right, or fetched.
    """
    os.makedirs(folder, exist_ok=True)

    def fetch(key: str, size: int) -> tuple[bytes, int]:
        parts = []
        for at in range(0, size, window):
            want = min(window, size - at)
            part = read_range(key, at, want)
            if len(part) != want:
                raise EngineError("provider_protocol_error", "a range has another length than asked for")
            parts.append(part)
        return b"".join(parts), len(parts)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                paths = [os.path.join(folder, r["id"] + x) for x in (".pack", ".idx")]
                if all(os.path.isfile(p) and os.path.getsize(p) == n for p, n in zip(paths, (r["pack_size"], r["index_size"]), strict=True)) and sound(*paths):
                    out.append((r["id"], "present", 0, 0))
                    continue
                (pack, n), (index, m) = fetch(r["pack_key"], r["pack_size"]), fetch(r["index_key"], r["index_size"])
                verify_pair(pack, index)
                publish(paths[0], pack)
                publish(paths[1], index)
                out.append((r["id"], "fetched", len(pack) + len(index), n + m))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["id", "status", "bytes", "requests"])

    return manifest.repartition("id").mapInArrow(run, "id string, status string, bytes long, requests long")
