"""Decoders of stored objects, each a function of one payload.

Trees, commits and tags have a grammar of variable length; they are decoded on
executors, batch by batch, by ``bough.operators.objects``.
"""

from __future__ import annotations

import re

from bough.model import EngineError

_IDENTITY = re.compile(rb"(.*?)[ ]*<([^>\n]*)>(?: (-?\d+)(?: (\S+))?)?\s*\Z", re.S)
_ZONE = re.compile(rb"([+-])([01]\d|2[0-3])([0-5]\d)")
_KINDS = {0o040000: "tree", 0o120000: "symlink", 0o160000: "gitlink"}
SUBJECT_BYTES, MESSAGE_BYTES = 1024, 64 << 10


def _malformed(what: str) -> EngineError:
    return EngineError("malformed_object", what)


def kind_of(mode: int) -> str:
    return _KINDS.get(mode & 0o170000, "blob")


def zone_minutes(tz: bytes) -> int | None:
    m = _ZONE.fullmatch(tz)
    return (1 if m[1] == b"+" else -1) * (int(m[2]) * 60 + int(m[3])) if m else None


def identity(raw: bytes) -> dict:
    m = _IDENTITY.fullmatch(raw)
    if not m:
        raise _malformed("identity")
    time = int(m[3]) if m[3] else 0
    if not -(1 << 63) <= time < 1 << 63:
        raise _malformed("time of an identity")
    tz = m[4] or b""
    return {"name": m[1].strip(b" "), "email": m[2], "time": time, "tz": tz, "tz_offset_minutes": zone_minutes(tz)}


def _headers(data: bytes) -> tuple[list[tuple[bytes, bytes]], bytes]:
    """Header fields in order, continuation lines joined; and the message."""
    head, gap, message = data.partition(b"\n\n")
    if not gap and head.endswith(b"\n"):
        head = head[:-1]
    out: list[tuple[bytes, bytes]] = []
    for line in head.split(b"\n"):
        if line.startswith(b" "):
            if not out:
                raise _malformed("continuation before any header")
            out[-1] = (out[-1][0], out[-1][1] + b"\n" + line[1:])
        else:
            key, _, value = line.partition(b" ")
            out.append((key, value))
    return out, message


def _oid(value: bytes) -> bytes:
    if not re.fullmatch(rb"[0-9a-f]{40}|[0-9a-f]{64}", value):
        raise _malformed("id in a header")
    return bytes.fromhex(value.decode())


def commit(data: bytes) -> dict:
    headers, message = _headers(data)
    if not headers or headers[0][0] != b"tree":
        raise _malformed("a commit begins with its tree")
    fields: dict[bytes, bytes] = {}
    parents, signatures = [], []
    for key, value in headers:
        if key == b"parent":
            parents.append(_oid(value))
        elif key in (b"gpgsig", b"gpgsig-sha256"):
            signatures.append(key)
        fields.setdefault(key, value)
    if b"author" not in fields or b"committer" not in fields:
        raise _malformed("a commit has an author and a committer")
    first = message.partition(b"\n")[0]
    return {
        "tree_oid": _oid(fields[b"tree"]),
        "parents": parents,
        "author": identity(fields[b"author"]),
        "committer": identity(fields[b"committer"]),
        "subject": first[:SUBJECT_BYTES],
        "subject_truncated": len(first) > SUBJECT_BYTES,
        "message_raw": message[:MESSAGE_BYTES],
        "message_truncated": len(message) > MESSAGE_BYTES,
        "signature_headers": signatures,
        "encoding": fields.get(b"encoding"),
    }


def tag(data: bytes) -> dict:
    headers, message = _headers(data)
    fields = dict(reversed(headers))
    if b"object" not in fields or b"type" not in fields or b"tag" not in fields:
        raise _malformed("a tag has an object, a type and a name")
    kind = fields[b"type"].decode("latin-1")
    if kind not in ("commit", "tree", "blob", "tag"):
        raise _malformed("type of a tag's target")
    tagger = fields.get(b"tagger")
    return {"target_oid": _oid(fields[b"object"]), "target_kind": kind, "name": fields[b"tag"], "tagger": identity(tagger) if tagger is not None else None, "message": message}


def tree(data: bytes, digest: int = 20) -> list[tuple[int, bytes, bytes, str]]:
    """(mode, name, oid, kind) of each entry, in stored order."""
    out, at = [], 0
    while at < len(data):
        space = data.find(b" ", at, at + 7)
        end = data.find(b"\0", space)
        if space < at + 1 or end < 0 or end + 1 + digest > len(data):
            raise _malformed("entry of a tree")
        raw = data[at:space]
        if not re.fullmatch(rb"[0-7]{1,6}", raw) or int(raw, 8) == 0:
            raise _malformed("mode of an entry")
        name = data[space + 1 : end]
        if name in (b"", b".", b"..") or b"/" in name:
            raise _malformed("name of an entry")
        mode = int(raw, 8)
        out.append((mode, name, data[end + 1 : end + 1 + digest], kind_of(mode)))
        at = end + 1 + digest
    return out


def encode_tree(entries: list[tuple[int, bytes, bytes]]) -> bytes:
    """The payload of a tree of (mode, name, oid), in stored order."""
    order = sorted(entries, key=lambda e: e[1] + (b"/" if kind_of(e[0]) == "tree" else b""))
    return b"".join(b"%o %s\0%s" % (mode, name, oid) for mode, name, oid in order)


def percent_encode(path: bytes) -> str:
    """Printable form: percent signs, controls and bytes that aren't valid UTF-8 as %XX."""
    out, at = [], 0
    while at < len(path):
        try:
            good, bad = path[at:].decode("utf-8"), b""
            at = len(path)
        except UnicodeDecodeError as e:
            good, bad = path[at : at + e.start].decode("utf-8"), path[at + e.start : at + e.end]
            at += e.end
        out += [f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else "".join(f"%{b:02X}" for b in c.encode()) if 0x80 <= ord(c) < 0xA0 else c for c in good]
        out += [f"%{b:02X}" for b in bad]
    return "".join(out)


def percent_decode(text: str) -> bytes:
    """The inverse; an incomplete escape is an error."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise EngineError("invalid_path", "incomplete percent escape")
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
