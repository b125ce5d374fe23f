"""Column expressions over bytes.

Spark's string functions count characters, so bytes are worked on as ISO-8859-1
text (``chars``): one character for each byte, without loss in either direction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = 8000
SUBJECT_BYTES, MESSAGE_BYTES = 1024, 64 << 10
#: mode bits of the kinds of tree entries.
FILE_TYPE = 0o170000


def chars(data: Column) -> Column:
    """Bytes as text of one character each."""
    return F.decode(data, "ISO-8859-1")


def octets(text: Column) -> Column:
    """The inverse of chars."""
    return F.encode(text, "ISO-8859-1")


def object_id(kind: Column | str, data: Column, algorithm: str = "sha1") -> Column:
    """Hex id of an object: the digest of its kind, its length in bytes, a NUL and its payload."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    whole = F.concat(F.encode(F.concat(kind, F.lit(" "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def is_oid(text: Column, algorithm: str = "sha1") -> Column:
    """Whether text is a full hexadecimal id."""
    return text.rlike("^[0-9a-fA-F]{%d}$" % {"sha1": 40, "sha256": 64}[algorithm])


def parse_oid(text: Column, algorithm: str = "sha1") -> Column:
    """Bytes of a full hexadecimal id; null for anything else."""
    return F.when(is_oid(text, algorithm), F.unhex(text))


def format_oid(oid: Column) -> Column:
    return F.lower(F.hex(oid))


def is_binary(data: Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.contains(F.substring(data, 1, PROBE), F.unhex(F.lit("00")))


def file_kind(data: Column, mode: Column) -> Column:
    """text, binary, symlink or gitlink; text must be free of NULs at its start and valid UTF-8."""
    text = ~is_binary(data) & F.is_valid_utf8(data.cast("string"))
    kind = mode.bitwiseAND(F.lit(FILE_TYPE))
    return F.when(kind == 0o160000, "gitlink").when(kind == 0o120000, "symlink").when(text, "text").otherwise("binary")


def entry_kind(mode: Column) -> Column:
    kind = mode.bitwiseAND(F.lit(FILE_TYPE))
    return F.when(kind == 0o040000, "tree").when(kind == 0o120000, "symlink").when(kind == 0o160000, "gitlink").otherwise("blob")


def tz_offset_minutes(tz: Column) -> Column:
    """Minutes of a raw zone such as -0730; null unless it is a sign, an hour under 24 and a minute under 60."""
    text = chars(tz) if not isinstance(tz, str) else F.col(tz)
    return zone_minutes(text)


def zone_minutes(text: Column) -> Column:
    """As tz_offset_minutes, of text."""
    amount = F.substring(text, 2, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int")
    return F.when(text.rlike(r"^[+-]([01][0-9]|2[0-3])[0-5][0-9]$"), F.when(F.substring(text, 1, 1) == "-", -amount).otherwise(amount))


def is_path(path: Column) -> Column:
    """A path (as chars) without NUL and without empty, '.' or '..' segments; the empty path is the root."""
    return (path == "") | (~F.contains(path, F.lit("\0")) & ~path.rlike(r"(^|/)(\.{0,2})(/|$)"))


def is_literal_path(path: Column) -> Column:
    """Free of wildcards and of the ':(' that begins pathspec magic."""
    return ~path.startswith(":(") & ~path.rlike(r"[*?\[]")


def is_ref_name(name: Column, strict: bool = False) -> Column:
    """A full reference name (as chars): HEAD, or refs/ and components as check-ref-format allows; strict bounds each to 255 bytes."""
    bad = r"(^|/)\.|\.\.|[\x00-\x20\x7f~^:?*\[\\]|@\{|//|/$|\.$|\.lock(/|$)"
    ok = (F.length(name) <= 4096) & ((name == "HEAD") | (name.startswith("refs/") & ~name.rlike(bad) & (F.length(name) > 5)))
    return ok & ~name.rlike("[^/]{256}") if strict else ok


def sort_key(path: Column, kind: Column) -> Column:
    """Key (bytes) of the stored tree order: directories compare as if a slash followed."""
    return F.when(kind == "tree", F.concat(path, F.unhex(F.lit("2F")))).otherwise(path)


def subject(message: Column) -> tuple[Column, Column]:
    """First line, cut at 1024 bytes, and whether it was cut."""
    at = F.instr(chars(message), "\n")
    line = F.when(at > 0, F.substring(message, F.lit(1), at - 1)).otherwise(message)
    return F.substring(line, 1, SUBJECT_BYTES), F.octet_length(line) > SUBJECT_BYTES


def line_count(data: Column) -> Column:
    """Newlines, and one for an unterminated last line."""
    text = chars(data)
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + ((text != "") & ~text.endswith("\n")).cast("int")).cast("long")


def lines(text: Column) -> Column:
    """Array of the lines of chars; no empty line follows a final newline, carriage returns stay."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def display(data: Column) -> Column:
    """For people: invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


_LFS_VERSIONS = ("version https://git-lfs.github.com/spec/v1", "version https://hawser.github.com/spec/v1", "version http://git-media.io/v/2")
_LFS_SPACE = r"[\x09-\x0d\x20\u0085   -     　]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lfs_pointer(data: Column) -> Column:
    """struct(oid, size) of a payload that is a large-file pointer; null for any other."""
    text = F.when((F.octet_length(data) <= 1024) & F.is_valid_utf8(data.cast("string")), data.cast("string"))
    body = F.regexp_replace(F.regexp_replace(text, "^" + _LFS_SPACE, ""), _LFS_SPACE + "$", "")
    rows = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")

    def of_rest(rest: Column) -> Column:
        well_formed = F.forall(rest, lambda x: x.rlike(r"^(oid sha256:[0-9a-f]{64}|size \+?[0-9]{1,19}|ext-[0-9]-[A-Za-z0-9_]\S* sha256:[0-9a-f]{64})$"))
        return F.when(well_formed, _let(F.transform(rest, lambda x: F.substring_index(x, " ", 1)), lambda keys: of_keys(rest, keys)))

    def of_keys(rest: Column, keys: Column) -> Column:
        ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))), lambda i: (F.size(keys) < 2) | (F.try_element_at(keys, i) < F.try_element_at(keys, i + 1)))
        distinct = _let(F.transform(F.filter(keys, lambda k: k.startswith("ext-")), lambda k: F.substring(k, 5, 1)), lambda p: F.size(F.array_distinct(p)) == F.size(p))
        field = lambda name, cut: F.substr(F.try_element_at(F.filter(rest, lambda x: x.startswith(name)), F.lit(1)), F.lit(cut))
        pair = F.struct(field("oid sha256:", 12).alias("oid"), field("size ", 6).try_cast("long").alias("size"))
        return F.when(ascending & distinct, _let(pair, lambda p: F.when(p["oid"].isNotNull() & (p["size"] >= 0), p)))

    first = lambda rows: F.try_element_at(rows, F.lit(1)).isin(*_LFS_VERSIONS)
    return _let(rows, lambda rows: F.when(first(rows), _let(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), of_rest)))
