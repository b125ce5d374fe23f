"""PII by weak supervision.

Candidate spans (tokens with an @, runs of digits and their separators, addresses of
four numbers or of groups of hexadecimal digits, long tokens of letters and digits,
values that are assigned to a password, token or key, given names of a gazetteer with
the capitalised words after them) are voted on by labelers: by regular
expressions, by gazetteers (top-level domains, issuer prefixes of cards, reserved
networks, given names, placeholders) and by context (words before the span, what it is joined to). A labeler
says private (1), not private (-1) or abstains (0). A run of digits that isn't shaped
like a card or a phone number as a whole gives the shaped numbers within it, chosen so
that they don't overlap and cover most of its digits, valid cards first; numbers that
stand next to numbers are found so. A run without such is one candidate. Expectation-maximisation over how
often each pattern of votes occurs, counted over all spans of all documents,
estimates the labelers' reliabilities; the posteriors are the soft labels with which
a logistic regression over the spans' own features is trained (counted by signature of
features, of which there are a bounded number). A span is reported if that
classifier holds it for private.

Edge cases: null and empty texts have no candidates. Whole texts are read, in time in
proportion to their length, also such without a blank.
Offsets count characters from 0. Documents without doc_id are scanned, their spans
carry a null. Rows that repeat give their spans each. Further columns aren't read. No
rows give no rows.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.llm.quality_rules import expectation_maximisation
from bough.llm.shared import spill

GIVEN = "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Daniel Matthew Anthony Mark Paul Steven Andrew Emily Emma Olivia Anna Maria Peter Hans Klaus Jürgen Stefan Andreas Sabine Ursula Monika Petra Heike Jean Pierre Michel Jacques François Marie Sophie Camille Isabelle Nathalie José Antonio Manuel Francisco Juan Carmen Dolores Pilar Lucía Elena".split()
_LOCAL = r"[^\s@<>\"'(),;:]"
CANDIDATE = re.compile(
    rf"(?P<email>(?<!{_LOCAL}){_LOCAL}+@{_LOCAL}+)"  # from the start of a run only: each character is looked at once
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|(?=::))(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]))"
    r"|(?<![A-Za-z])(?i:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?(?P<assigned>[^\s\"',;]{6,})"
    r"|(?P<secret>(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2})"
    rf"|(?P<name>(?<!\w)(?:{'|'.join(GIVEN)})(?: [A-Z]\.)?(?: [A-ZÀ-Þ][A-Za-zÀ-ÿ'-]+){{1,2}}(?!\w))"
)
PLACEHOLDERS = frozenset("password passwd secret token changeme example none null true false string required optional undefined xxxxxx ******".split())
_NUMBER = re.compile(r"(?<![\w.])\+?\(?\d(?:[ ().-]{0,3}\d){6,18}(?![\d])")
#: Numbers next to each other, at whatever length.
_RUN = re.compile(r"(?<![\w.])\+?\(?\d(?:[ ().-]{0,3}\d){6,}")
KINDS = ("email", "ip", "secret", "card", "phone", "name")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{8,15}")
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}")
_PHONE_PART = re.compile(rf"(?<![\d+])(?:{_PHONE.pattern})(?!\d)")
_CARD_PART = re.compile(rf"(?<![\d+])(?<!\d\.)(?:{_CARD.pattern})(?!\d)")
_DATE = re.compile(r"(?:1[89]|20)\d\d[-. /](?:0?[1-9]|1[0-2])[-. /](?:0?[1-9]|[12]\d|3[01])\b.*|(?:0?[1-9]|[12]\d|3[01])[-. /](?:0?[1-9]|1[0-2])[-. /](?:1[89]|20)\d\d\b.*")
_HEX = re.compile(r"[0-9a-f]{32,}|[A-Za-z0-9+/_-]{32,}={0,2}")
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl ru cn jp kr in br au ca us eu se no dk fi ie pt cz gr hu tr il za mx ar cl nz me tv app dev ai cloud".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|36|30[0-5]|62")
RESERVED = re.compile(r"0\.|127\.|255\.|22[4-9]\.|23\d\.")
_SAYS = re.compile(r"(?:e-?mail|mail|contact|write|phone|tel|telefon|telephone|call|fax|mobile|card|visa|karte|carte|tarjeta|ip|host|address|adresse|token|key|secret|password|passwd|pwd|auth|bearer|credential)\W{0,4}$", re.I)
_NAMED = re.compile(r"(?:name(?: is)?|mrs?|ms|dr|prof|herr|frau|señora?|madame|monsieur|signed|by|from|dear|contact|call|regards|patient|customer)\W{0,3}$", re.I)
_DENIES = re.compile(r"(?:version|release|v|isbn|issn|doi|order|invoice|no|nr|page|pages|total|section|id|sha1|sha256|md5|commit|checksum|digest|rev)\W{0,3}$", re.I)
LABELERS = ("shape", "checksum", "gazetteer", "context", "joined", "date", "uniform")


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def numbers(text: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """Spans of the candidate numbers of a run of digits and their separators."""
    run = text[begin:stop]
    if _CARD.fullmatch(run) or _PHONE.fullmatch(run):
        return [(begin, stop)]
    parts = {m.span() for k in range(begin, stop) if text[k] in "+(0123456789" for shape in (_CARD_PART, _PHONE_PART) if (m := shape.match(text, k, stop))}
    parts = sorted(parts, key=lambda x: (x[1], x[0]))
    best, link, ends = [(0, 0, 0)], [(0, False)], [b for _, b in parts]  # over the first parts by their end: digits in valid cards, digits, parts (fewer is better); where the choice goes on, and whether the part is in it
    for n, (a, b) in enumerate(parts):
        digits = re.sub(r"\D", "", text[a:b])
        valid = len(digits) if _CARD.fullmatch(text[a:b]) and ISSUERS.match(digits) and luhn(digits) else 0
        k = bisect_right(ends, a, 0, n)
        now = (best[k][0] + valid, best[k][1] + len(digits), best[k][2] - 1)
        use = now > best[n]
        best.append(now if use else best[n])
        link.append((k, True) if use else (n, False))
    out, n = [], len(parts)
    while n:
        if link[n][1]:
            out.append(parts[n - 1])
        n = link[n][0]
    return out[::-1] or [m.span() for m in _NUMBER.finditer(text, begin, stop)]


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates, in order; numbers are looked for between the others."""
    out, at = [], 0
    for m in [*CANDIDATE.finditer(text), None]:
        for run in _RUN.finditer(text, at, m.start() if m else len(text)):
            out += [(a, b, "number") for a, b in numbers(text, *run.span())]
        if m:
            out.append((*m.span(m.lastgroup), m.lastgroup))
            at = m.end()
    return out


def candidate(start: int, end: int, kind: str, text: str) -> tuple[int, int, str, str, tuple[int, ...], tuple[int, ...]]:
    """(start, end, kind, value, votes, features) of a span."""
    value = text[start:end]
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        cut = value.rstrip(".!?*#$%&|")
        if g := _EMAIL.match(cut):  # what is stuck to its end isn't part of it
            cut = g.group()
        end, value = start + len(cut), cut
        digits = re.sub(r"\D", "", value)
    elif kind == "number":
        kind = "card" if _CARD.fullmatch(value) else "phone"
    if kind in ("assigned", "secret"):
        told, kind = kind == "assigned", "secret"
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    hint = 1 if _SAYS.search(before) or (kind == "secret" and re.search(r"[=:]\s*[\"']?$", before)) else -1 if _DENIES.search(before) else 0
    if kind == "email":
        shape = 1 if _EMAIL.fullmatch(value) else -1
        known = 1 if value.rpartition(".")[2].lower() in TOP_LEVEL else -1
        check = 0
    elif kind == "ip6":
        kind = "ip"
        try:
            address = ipaddress.IPv6Address(value)
            shape, known = 1, -1 if address.is_loopback or address.is_unspecified else 0 if address.is_link_local or address.is_multicast else 1
        except ValueError:
            shape, known = -1, -1
        check = 0
    elif kind == "name":
        shape, known, check = 1, 1, 0
        hint = 1 if _NAMED.search(before) else 0
    elif kind == "ip":
        octets = [int(x) for x in value.split(".")]
        shape = 1 if max(octets) <= 255 else -1
        known = -1 if value in ("0.0.0.0", "127.0.0.1", "255.255.255.255") else 0 if RESERVED.match(value) else 1
        check = -1 if any(len(x) > 1 and x[0] == "0" for x in value.split(".")) else 0
    elif kind == "secret":
        shape = 1 if _HEX.fullmatch(value) or told else 0
        known = -1 if value.lower() in PLACEHOLDERS else 0
        counts = np.unique(list(value), return_counts=True)[1] / len(value)
        check = 1 if -(counts * np.log2(counts)).sum() > (2.5 if told else 3.2) else -1
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) else 0
        known = 1 if ISSUERS.match(digits) else -1
        check = 1 if luhn(digits) else 0
    else:
        shape = 1 if _PHONE.fullmatch(value) else -1
        known = 1 if value[0] in "+(" or value.startswith("00") else 0
        check = 1 if 7 <= len(digits) <= 15 else -1
    left, right = before[-1:], after[:1]
    joined = -1 if (left.isalnum() or right.isalnum()) and kind not in ("email", "name") else 0
    if right == "." and after[1:2].isdigit():
        joined = -1
    date = -1 if kind in ("phone", "card") and _DATE.fullmatch(value) else 0
    uniform = -1 if len(set(digits)) == 1 and len(digits) > 3 else 1 if len(set(digits)) >= 4 and kind not in ("email", "name") else 0
    votes = (shape, check, known, hint, joined, date, uniform)
    features = (KINDS.index(kind), min(len(value) // 4, 10), min(len(digits) // 3, 7), "+" in value, "(" in value, "-" in value, "." in value, " " in value, shape + 1, known + 1, hint + 1, joined + 1, date + 1, uniform + 1, _class(left), _class(right), _said(before))
    return start, end, kind, value, votes, tuple(int(x) for x in features)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "=:\"'" else 4


def _said(before: str) -> int:
    """The last word before a span, by its hash: a feature that no labeler looks at."""
    words = _WORD.findall(before)
    return zlib.crc32(words[-1].lower().encode()) % 16 if words else 16


_WORD = re.compile(r"[^\W\d_]+")
_SPAN = "doc_id long, start long, end long, kind string, value string, votes array<int>, features array<int>"


def candidates(docs: DataFrame) -> DataFrame:
    """All candidate spans with their votes and features."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for span in spans(text):
                    ids.append(i)
                    out.append(candidate(*span, text))
            if out:
                a, b, kind, value, votes, features = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(ids)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind), pa.array(value), pa.array(list(votes), pa.list_(pa.int32())), pa.array(list(features), pa.list_(pa.int32()))], ["doc_id", "start", "end", "kind", "value", "votes", "features"]
                )

    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, _SPAN)


_SIZES = (len(KINDS), 11, 8, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 5, 5, 17)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])


def regression(signatures: np.ndarray, positive: np.ndarray, count: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of one-hot features and a bias, by Newton's method on soft labels: positive of count at each signature."""
    x = np.zeros((len(signatures), sum(_SIZES) + 1))
    if len(signatures):
        x[np.arange(len(signatures))[:, None], signatures + _OFFSETS] = 1
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (count * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (positive - count * p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, value, probability) of every span held for private."""
    spans = spill(candidates(docs))
    rows = spans.groupBy("votes", "features").count().collect()  # bounded by the labelers' and features' values
    rows.sort(key=lambda r: (r[0], r[1]))
    patterns = np.array([r[0] for r in rows], int).reshape(-1, len(LABELERS))
    count = np.array([r[2] for r in rows], float)
    table, share = expectation_maximisation(patterns, count, start=(0.7, 0.1), share=0.7)
    odds = np.log(share / (1 - share)) + (patterns == -1) @ np.log(table[1] / table[0]) + (patterns == 1) @ np.log((1 - table[1]) / (1 - table[0]))
    posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    w = regression(np.array([r[1] for r in rows], int).reshape(-1, len(_SIZES)), posterior * count, count)
    z = F.lit(float(w[-1]))
    for k, (size, at) in enumerate(zip(_SIZES, _OFFSETS.tolist(), strict=True)):
        z = z + F.element_at(F.array(*(F.lit(float(x)) for x in w[at : at + size])), F.col("features")[k] + 1)
    return spans.withColumn("probability", 1 / (1 + F.exp(-z))).where(F.col("probability") >= least).select("doc_id", "start", "end", "kind", "value", "probability")
