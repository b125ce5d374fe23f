"""The grammar of configuration files, as far as declarations of submodules need it."""

from __future__ import annotations

from collections.abc import Iterator

from bough.model import EngineError

MOST = 1 << 20


def _fail(line: int) -> EngineError:
    return EngineError("malformed_object", "the configuration can't be parsed", reason="git_config_parse_error", line=line)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.line = data.removeprefix(b"\xef\xbb\xbf"), 0, 1

    def take(self) -> int:
        """The next byte, a newline for CR LF; -1 at the end, which also counts as the end of a line."""
        if self.at >= len(self.data):
            return -1
        c = self.data[self.at]
        self.at += 1
        if c == 13 and self.data[self.at : self.at + 1] == b"\n":
            c = 10
            self.at += 1
        if c == 10:
            self.line += 1
        return c

    def peek(self) -> int:
        return self.data[self.at] if self.at < len(self.data) else -1


def _section(r: _Reader) -> bytes:
    name = b""
    while True:
        c = r.take()
        if c == 93:
            return name.lower()
        if c in (32, 9):
            break
        if not (c >= 0 and (chr(c).isalnum() and c < 128 or c in b"-.")):
            raise _fail(r.line - (c == 10))
        name += bytes([c])
    while (c := r.take()) in (32, 9):
        pass
    if c != 34:
        raise _fail(r.line - (c == 10))
    sub = b""
    while (c := r.take()) != 34:
        if c in (-1, 10):
            raise _fail(r.line - (c == 10))
        if c == 92:
            c = r.take()
            if c in (-1, 10):
                raise _fail(r.line - (c == 10))
        sub += bytes([c])
    if r.take() != 93:
        raise _fail(r.line)
    return name.lower() + b"." + sub


def _value(r: _Reader) -> bytes:
    out, quoted, comment, keep = bytearray(), False, False, 0
    while True:
        c = r.take()
        if c in (-1, 10):
            if quoted:
                raise _fail(r.line - (c == 10))
            return bytes(out[:keep])
        if comment:
            continue
        if not quoted and c in (32, 9, 11, 12, 13):
            if out:
                out.append(c)
            continue
        if not quoted and c in b";#":
            comment = True
            continue
        if c == 92:
            c = r.take()
            if c == 10:
                continue
            escaped = {116: 9, 98: 8, 110: 10, 92: 92, 34: 34}.get(c)
            if escaped is None:
                raise _fail(r.line)
            out.append(escaped)
        elif c == 34:
            quoted = not quoted
        else:
            out.append(c)
        keep = len(out)


def parse(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """(section.key, value) in order; keys and sections in lower case, a key without '=' has None."""
    r, section = _Reader(data), None
    while True:
        c = r.take()
        if c == -1:
            return
        if c in (10, 32, 9, 11, 12, 13):
            continue
        if c in b"#;":
            while r.take() not in (-1, 10):
                pass
            continue
        if c == 91:
            section = _section(r)
            continue
        if section is None or not (c < 128 and chr(c).isalpha()):
            raise _fail(r.line)
        key = bytes([c])
        while (n := r.peek()) >= 0 and n < 128 and (chr(n).isalnum() or n == 45):
            key += bytes([r.take()])
        while r.peek() in (32, 9):
            r.take()
        c = r.take()
        if c in (-1, 10):
            yield section + b"." + key.lower(), None
        elif c == 61:
            yield section + b"." + key.lower(), _value(r).partition(b"\0")[0]
        else:
            raise _fail(r.line)


def declarations(data: bytes) -> list[dict[str, bytes | None]]:
    """Submodules that have a path, by name; the last value of a key counts."""
    if len(data) > MOST:
        raise EngineError("object_too_large", "the declarations exceed 1 MiB")
    found: dict[bytes, dict[str, bytes | None]] = {}
    for key, value in parse(data):
        if not key.startswith(b"submodule."):
            continue
        name, dot, field = key[len(b"submodule.") :].rpartition(b".")
        if dot and field in (b"path", b"url", b"branch"):
            found.setdefault(name, {"path": None, "url": None, "branch": None})[field.decode()] = value
    return [{"name": n, **d} for n, d in sorted(found.items()) if d["path"] is not None]
