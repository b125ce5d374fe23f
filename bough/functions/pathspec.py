"""Pathspecs as regular expressions that the JVM evaluates.

Without a wildcard a pattern names a path and everything under it. Otherwise it is a
glob: ``*`` and ``?`` stay within a component, ``**`` as a whole component spans any
number of them. A leading ``:(glob)`` makes a pattern a glob in any case. Patterns are
matched against paths as chars (one character a byte); several are alternatives, none
at all matches everything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bough.model import EngineError

_GLOB = ":(glob)"
_META = re.compile(r"[*?\[\\]")


def _latin(pattern: str | bytes) -> str:
    return (pattern.encode() if isinstance(pattern, str) else pattern).decode("latin-1")


def is_glob(pattern: str) -> bool:
    return pattern.startswith(_GLOB) or bool(re.search(r"[*?\[]", pattern))


def _class(p: str, i: int) -> tuple[str, int]:
    """A bracket expression from p[i] == '['; a lone bracket stands for itself."""
    j = i + 1
    negated = j < len(p) and p[j] in "!^"
    j += negated
    start = j
    while j < len(p) and (p[j] != "]" or j == start):
        j += 2 if p[j] == "\\" else 1
    if j >= len(p):
        return r"\[", i + 1
    inner, k, out = p[start:j], 0, ""
    while k < len(inner):
        if m := re.match(r"\[:(\w+):\]", inner[k:]):
            out += r"\p{" + m[1].capitalize() + "}"
            k += m.end()
            continue
        if inner[k] == "\\" and k + 1 < len(inner):
            k += 1
            out += re.escape(inner[k])
        elif inner[k] == "-" and 0 < k < len(inner) - 1:
            out += "-"
        else:
            out += re.escape(inner[k]) if not inner[k].isalnum() else inner[k]
        k += 1
    return f"(?!/)[{'^' if negated else ''}{out}]", j + 1


def compile_one(pattern: str | bytes) -> str:
    """A regular expression for whole paths."""
    p = _latin(pattern)
    if not is_glob(p):
        p = p.rstrip("/")
        return "" if not p else re.escape(p) + "(?:/.*)?"
    p = p.removeprefix(_GLOB)
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and (i == 0 or p[i - 1] == "/"):
            out, i = out + ".*", len(p)
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[":
            piece, i = _class(p, i)
            out += piece
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return out


def compile_all(patterns: list[str | bytes]) -> str | None:
    """One anchored expression for all patterns; None if everything matches."""
    for p in patterns:
        if not isinstance(p, str | bytes):
            raise TypeError("pathspecs must be text or bytes")
        if "\0" in _latin(p):
            raise EngineError("invalid_argument", "a pathspec holds a NUL")
    each = [compile_one(p) for p in patterns]
    if not each or "" in each:
        return None
    return r"(?s)\A(?:" + "|".join(each) + r")\z"


def fixed_directory(pattern: str | bytes) -> str:
    """The directory prefix, with its slash, that every match of a pattern has; may be empty."""
    p = _latin(pattern)
    if not is_glob(p):
        return p.rstrip("/")
    p = p.removeprefix(_GLOB)
    m = _META.search(p)
    head = p[: m.start()] if m else p
    return head[: head.rfind("/") + 1]


def matches(path: Column, patterns: list[str | bytes]) -> Column:
    """Whether a path (chars) matches. The common prefixes go along as startsWith, which reaches the Parquet scan."""
    expression = compile_all(patterns)
    if expression is None:
        return F.lit(True)
    hit = path.rlike(expression)
    prefixes = sorted({fixed_directory(p) for p in patterns})
    if "" in prefixes:
        return hit
    starts = path.startswith(prefixes[0])
    for p in prefixes[1:]:
        starts = starts | path.startswith(p)
    return starts & hit


def may_hold(directory: Column, patterns: list[str | bytes]) -> Column:
    """Whether a directory (chars) can hold a match: it and the pattern's fixed directory lie on one branch."""
    if compile_all(patterns) is None:
        return F.lit(True)
    slashed = F.concat(directory, F.lit("/"))
    out = F.lit(False)
    for p in patterns:
        fixed = fixed_directory(p)
        out = out | slashed.startswith(fixed if fixed.endswith("/") or not fixed else fixed + "/") | F.lit(fixed if fixed.endswith("/") else fixed + "/").startswith(slashed)
    return out
