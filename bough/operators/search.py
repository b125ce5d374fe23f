"""Content search: one row for each line with a hit, in one pass over the files without a shuffle.

Offsets and caps count bytes; lines are worked on as chars, one character a byte, so
that the JVM's expressions do all of it within generated code. Regular expressions
are the subset that a linear-time engine has; look-around, back references, and
possessive or atomic groups are refused.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bough.functions import octets as O
from bough.functions import pathspec
from bough.model import EngineError

PREVIEW, SUBMATCHES, CONTEXT = 1024, 256, 32
MODES = ("literal", "regex")


def check_regex(query: str) -> None:
    """Refuse what a linear-time engine doesn't have, and what the JVM's engine can't run in linear time and bounded depth: repeated groups that hold a choice or a repetition."""
    if len(query) > 1 << 20:
        raise EngineError("unsupported_regex", "the expression is too large")
    try:
        pc.match_substring_regex(pa.array([b""], pa.binary()), query.encode())  # a linear-time engine of its own: refuses look-around, back references and wrong syntax
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise EngineError("unsupported_regex", str(error)) from None
    # look at it without escaped pairs and bracket classes
    bare = re.sub(r"\\\\", "", query)
    if re.search(r"\\[1-9]|\\k<|\\G|\\Z|\\Q|\\C", bare):
        raise EngineError("unsupported_regex", "back references and anchors of a backtracking engine")
    bare = re.sub(r"\\.", "x", bare, flags=re.S)
    if any(ord(c) > 127 for part in re.findall(r"\[\^?\]?[^\]]*\]", bare) for c in part):
        raise EngineError("unsupported_regex", "a class of other than ASCII characters")
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "x", bare)
    if re.search(r"[*+?}]\+", bare):
        raise EngineError("unsupported_regex", "possessive repetition")
    inner: list[bool] = [False]  # of each open group whether it holds a choice or a repetition
    at = 0
    while at < len(bare):
        c = bare[at]
        if c == "(":
            inner.append(False)
            at += len(re.match(r"\((?:\?(?:P?<\w+>|[a-zA-Z-]*:?))?", bare[at:]).group())
            continue
        many = re.match(r"(?:[*+]|\{\d+,\d*\}|\{[1-9]\d+\}|\{[2-9]\})", bare[at + 1 :])
        if c == ")" and len(inner) > 1:
            held = inner.pop()
            if many and held:
                raise EngineError("unsupported_regex", "a repeated group that holds a choice or a repetition")
            inner[-1] = inner[-1] or held or bool(many)
        elif c == "|" or many or (c in "*+" and at):
            inner[-1] = True
        at += 1


def pattern(query: str, mode: str = "literal", case_sensitive: bool = True) -> str:
    """The Java expression on chars, for a query of UTF-8 text; case folds in ASCII only."""
    if mode not in MODES:
        raise EngineError("invalid_argument", f"unknown mode {mode!r}")
    flags = "(?d)" if case_sensitive else "(?id)"
    if mode == "literal":
        return flags + "".join(f"\\x{b:02x}" for b in query.encode())
    check_regex(query)
    query = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P?<\w+>", r"\1(?:", query)  # names of groups play no part
    return flags + "".join(c if ord(c) < 128 else "(?:" + "".join(f"\\x{b:02x}" for b in c.encode()) + ")" for c in query)


def _start(line: Column, query: str, mode: str, expression: str) -> Column:
    """Offset of the first hit, or -1; the line is known to hold one if it isn't a literal."""
    if mode == "literal":
        return F.instr(line, F.lit(query.encode().decode("latin-1"))) - 1
    return F.length(F.substring_index(F.regexp_replace(line, f"(?s)^(.*?)({expression}).*$", "$1Ā"), "Ā", 1))


def submatches(line: Column, query: str, mode: str, expression: str) -> Column:
    """Array of (start, length) of the hits that start within the preview, 256 at most, cut at its end."""
    length = F.least(F.length(line), F.lit(PREVIEW))
    if not query and mode == "literal":
        return F.when(length == 0, F.array().cast("array<struct<start:int,length:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.least(length, F.lit(SUBMATCHES)) - 1), lambda i: F.struct(i.cast("int").alias("start"), F.lit(0).alias("length"))))
    whole = F.regexp_extract_all(line, F.lit(f"({expression})"), F.lit(1))
    # the pieces between hits, from one marked copy of the line
    gaps = F.split(F.regexp_replace(line, f"(?:{expression})", "Ā"), "Ā", -1)
    n = F.least(F.size(whole), F.lit(SUBMATCHES))
    sizes = F.zip_with(gaps, whole, lambda g, w: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("g"), F.coalesce(F.length(w), F.lit(0)).alias("w")))
    start_state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    walked = F.aggregate(
        F.when(n > 0, F.slice(sizes, F.lit(1), F.greatest(n, F.lit(0)))),
        start_state,
        lambda s, x: F.struct(
            (s["at"] + x["g"] + x["w"]).alias("at"),
            F.when(s["at"] + x["g"] < length, F.array_append(s["out"], F.struct((s["at"] + x["g"]).alias("start"), (F.least(s["at"] + x["g"] + x["w"], length) - s["at"] - x["g"]).alias("length")))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.coalesce(walked, F.array().cast("array<struct<start:int,length:int>>"))


def search(files: DataFrame, query: str, mode: str = "literal", case_sensitive: bool = True, scope: str = "", pathspecs: list[str] | None = None, binary: str = "skip", context_lines: int = 0, max_object_bytes: int = 4 << 20, spans: bool = True) -> DataFrame:
    """Matching lines of files (path, mode, kind, oid, size, data).

    Columns: path, blob_oid, ordinal (of the line among the file's hits), line (from
    1), column (bytes, from 0), preview, preview_truncated, submatches,
    submatches_truncated, context_before, context_after, context_truncated (whether any
    of their lines was cut, at 1024 bytes). Symbolic links and gitlinks
    aren't searched; binary files are only with binary="text"; larger ones than
    max_object_bytes aren't (see ``skipped``).
    """
    if binary not in ("skip", "text"):
        raise EngineError("invalid_argument", "binary is 'skip' or 'text'")
    if not 0 <= context_lines <= CONTEXT:
        raise EngineError("invalid_argument", f"context_lines lies between 0 and {CONTEXT}")
    expression = pattern(query, mode, case_sensitive)
    plain = mode == "literal" and case_sensitive
    chosen = searched(files, scope, pathspecs).where(F.col("size") <= max_object_bytes)
    if binary == "skip":
        chosen = chosen.where(~O.is_binary(F.col("data")))
    text = O.chars(F.col("data"))
    needle = query.encode().decode("latin-1")
    if query:
        chosen = chosen.where(text.contains(needle) if plain else text.rlike("(?m)" + expression) if mode == "regex" else text.rlike(expression))
    # a file's hits are numbered within its row: no payload and no hit is shuffled
    wanted = lambda x: (F.lit(True) if not query else x.contains(needle)) if plain else x.rlike(expression)
    split = chosen.select("path", F.col("oid").alias("blob_oid"), O.lines(text).alias("lines"))
    numbered = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("said"))), lambda x: wanted(x["said"]))
    hit = split.select("path", "blob_oid", "lines" if context_lines else F.lit(None).alias("lines"), F.posexplode(numbered).alias("nth", "hit")).select("path", "blob_oid", "lines", "nth", "hit.at", "hit.said")
    if context_lines:
        cut = lambda first, n: F.transform(F.slice("lines", first, n), lambda x: O.octets(F.substring(x, 1, PREVIEW)))
        start = F.greatest(F.col("at") - context_lines, F.lit(0))
        before, after = cut(start + 1, F.col("at") - start), cut(F.col("at") + 2, F.lit(context_lines))
        long = F.exists(F.concat(F.slice("lines", start + 1, F.col("at") - start), F.slice("lines", F.col("at") + 2, F.lit(context_lines))), lambda x: F.length(x) > PREVIEW)
    else:
        before = after = F.array().cast("array<binary>")
        long = F.lit(False)
    spots = submatches(F.col("said"), query, mode, expression) if spans else F.array().cast("array<struct<start:int,length:int>>")
    first = F.instr("said", needle) - 1 if plain else _start(F.col("said"), query, "regex", expression)
    preview = F.substring("said", 1, PREVIEW)
    hits = (F.length("said") + 1) if not query and mode == "literal" else F.regexp_count("said", F.lit(expression))
    rows = hit.select("path", "blob_oid", (F.col("nth") + 1).alias("ordinal"), (F.col("at") + 1).alias("line"), first.cast("int").alias("column"), O.octets(preview).alias("preview"), (F.length("said") > PREVIEW).alias("preview_truncated"), spots.alias("submatches"), (hits if spans else F.lit(0)).alias("hits"), before.alias("context_before"), after.alias("context_after"), long.alias("context_truncated"))
    return rows.select("path", "blob_oid", "ordinal", "line", "column", "preview", "preview_truncated", "submatches", (F.col("hits") > F.size("submatches")).alias("submatches_truncated"), "context_before", "context_after", "context_truncated")


def searched(files: DataFrame, scope: str = "", pathspecs: list[str] | None = None) -> DataFrame:
    """The blobs (no links) that a search looks at, by scope and pathspecs."""
    text = O.chars(F.col("path"))
    out = files.where(F.col("kind") == "blob")
    if scope:
        under = scope.encode().decode("latin-1")
        out = out.where((text == under) | text.startswith(under + "/"))
        text = F.when(text == under, F.element_at(F.split(text, "/"), -1)).otherwise(F.substr(text, F.lit(len(under) + 2)))
    return out.where(pathspec.matches(text, pathspecs or []))


def skipped(files: DataFrame, max_object_bytes: int = 4 << 20, **where: object) -> DataFrame:
    """(path, size) of files too large to be searched."""
    return searched(files, **where).where(F.col("size") > max_object_bytes).select("path", "size")


def statistics(files: DataFrame, max_object_bytes: int = 4 << 20, **where: object) -> DataFrame:
    """One row: files, distinct blobs scanned, duplicates, binary and oversize ones left out."""
    chosen = searched(files, **where).select("oid", "size", O.is_binary(F.col("data")).alias("binary"))
    fits = F.col("size") <= max_object_bytes
    return chosen.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct(F.when(fits & ~F.col("binary"), F.col("oid"))).alias("blobs_scanned"),
        (F.count_if(fits & ~F.col("binary")) - F.count_distinct(F.when(fits & ~F.col("binary"), F.col("oid")))).alias("blobs_deduped"),
        F.count_if(fits & F.col("binary")).alias("binary_skipped"),
        F.count_if(~fits).alias("oversize_skipped"),
    )
