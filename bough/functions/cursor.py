"""Continuation cursors: checked, bound to one snapshot, operation and set of options."""

from __future__ import annotations

import base64
import struct
import zlib
from dataclasses import dataclass

from bough.model import EngineError

MOST = 4096
OPERATIONS = {"list_tree": 1, "search": 2, "log": 3, "history": 4, "refs": 5}
_DIGEST = {"sha1": (1, 20), "sha256": (2, 32)}


def fnv1a_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(options: dict[str, object]) -> int:
    """Of the options that define a result; how much of it is asked for plays no part."""
    part = sorted((k, repr(v)) for k, v in options.items() if k not in ("limit", "cursor", "limits"))
    return fnv1a_64(repr(part).encode())


@dataclass(frozen=True)
class Cursor:
    snapshot: bytes
    operation: str
    fingerprint: int
    position: bytes
    generation: bytes = b""
    hash_kind: str = "sha1"

    def encode(self) -> str:
        tag, size = _DIGEST[self.hash_kind]
        if len(self.snapshot) != size:
            raise EngineError("internal_error", "the snapshot's digest has a wrong length")
        body = bytes([1, tag]) + self.snapshot + bytes([OPERATIONS[self.operation]]) + struct.pack("<Q", self.fingerprint)
        for part in (self.generation, self.position):
            body += struct.pack("<H", min(len(part), 0xFFFF)) + part
        whole = body + struct.pack("<I", zlib.crc32(body))
        if len(whole) > MOST:
            raise EngineError("result_too_large", "the position doesn't fit into a cursor")
        return base64.urlsafe_b64encode(whole).rstrip(b"=").decode()


def decode(text: str, snapshot: bytes, operation: str, fingerprint_: int, hash_kind: str = "sha1") -> Cursor:
    """The cursor, if it belongs to this query; the checks run in a fixed order."""

    def fail(what: str) -> EngineError:
        return EngineError("invalid_cursor", what)

    if not isinstance(text, str):
        raise TypeError("a cursor is text")
    try:
        if "=" in text or any(c in text for c in "+/"):
            raise ValueError
        raw = base64.b64decode(text.encode("ascii") + b"=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except ValueError as e:
        raise fail("it isn't unpadded URL-safe base64") from e
    if len(raw) > MOST:
        raise fail("length")
    if len(raw) < 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise fail("checksum")
    body = raw[:-4]
    tag, size = _DIGEST[hash_kind]
    if body[:1] != b"\x01":
        raise fail("version")
    if body[1:2] != bytes([tag]):
        raise fail("hash kind")
    if body[2 : 2 + size] != snapshot:
        raise fail("snapshot")
    at = 2 + size
    if body[at : at + 1] != bytes([OPERATIONS[operation]]):
        raise fail("operation")
    if len(body) < at + 9 or struct.unpack("<Q", body[at + 1 : at + 9])[0] != fingerprint_:
        raise fail("options")
    at += 9
    parts = []
    for what in ("generation", "position"):
        if len(body) < at + 2:
            raise fail(what)
        n = struct.unpack("<H", body[at : at + 2])[0]
        part = body[at + 2 : at + 2 + n]
        if len(part) != n:
            raise fail(what)
        parts.append(part)
        at += 2 + n
    if at != len(body):
        raise fail("trailing data")
    return Cursor(snapshot, operation, fingerprint_, parts[1], parts[0], hash_kind)
