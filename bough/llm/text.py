"""Vectorised text kernels: Arrow string arrays in, numpy arrays out.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters; everything else separates words. ASCII letters are folded to lower
case here, other letters only if the caller lower-cased the column in the JVM.
A word's hash is a function of its bytes alone. Null texts count as empty.

Texts are worked through in blocks of ``BLOCK`` bytes, so the scratch space does
not grow with the length of a text; a longer text is cut between two words and
its pieces keep the same row number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)

#: Classes of bytes: 0 separates, runs of another class are words.
WORDS = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORDS[_a:_b] = 1
#: The same, with runs of punctuation as words too.
TOKENS = WORDS.copy()
TOKENS[33:127][WORDS[33:127] == 0] = 2
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(mul: int, n: int) -> np.ndarray:
    key = f"{mul}"
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, BLOCK + 1), mul, np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, starting at 0) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw


def blocks(offs: np.ndarray, raw: np.ndarray, classes: np.ndarray = WORDS) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end where a row or a word ends."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            row = offs[np.searchsorted(offs, b, "right") - 1]
            if row > a:
                b = int(row)
            else:  # inside one long text: back to a separator, on to one if there is none
                gap = np.flatnonzero(classes[raw[a:b]] == 0)
                if len(gap):
                    b = a + int(gap[-1]) + 1
                else:
                    end = int(offs[np.searchsorted(offs, b, "left")])
                    gap = np.flatnonzero(classes[raw[b:end]] == 0)
                    b = b + int(gap[0]) if len(gap) else end
        yield a, b
        a = b


def words(column: pa.Array, spans: bool = False, classes: np.ndarray = WORDS) -> tuple[np.ndarray, ...]:
    """Row number (int32) and hash (uint64) of every word, in order; with spans also its first byte and the byte after its last, from the start of the column."""
    offs, raw = buffers(column)
    rows, hashes, starts, ends = [], [], [], []
    for a, b in blocks(offs, raw, classes):
        part = raw[a:b]
        kind = classes[part]
        first = kind > 0
        last = first.copy()
        change = kind[1:] != kind[:-1]
        first[1:] &= change
        last[:-1] &= change
        cut = offs[np.searchsorted(offs, a, "left") : np.searchsorted(offs, b, "left")] - a
        first[cut] = kind[cut] > 0
        cut = cut[cut > 0] - 1
        last[cut] = kind[cut] > 0
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_FOLD[part] * _power(_MUL, len(part) + 1)[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power(_INV, len(part) + 1)[s]))
        rows.append((np.searchsorted(offs, s + a, "right") - 1).astype(np.int32))
        if spans:
            starts.append(s + a)
            ends.append(e + a)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    out = (cat(rows, np.int32), cat(hashes, np.uint64))
    return out + (cat(starts, np.int64), cat(ends, np.int64)) if spans else out


def grams(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words of one row: index of the first word, hash."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_MUL) + h[k : k + m])
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return at, out[at]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together, one row at least."""
    offs, _ = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def in_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int = 1 << 22):
    """For mapInArrow: f on bounded parts of every batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return run
