"""LM scoring by Ziv-Merhav cross-parsing.

Each document is parsed against the text of all other documents of the corpus, whole.
Its tokens (words, lower-cased, and runs of punctuation) are divided greedily from
left to right into phrases: the longest run, of any length, that occurs in another
document, or one token where no run of two does. With n tokens in the document, c such
phrases, m tokens in all other texts (each distinct text once) and c' phrases in the
document's own incremental (LZ78) parsing,

    cross_entropy    = c * log2(m) / n
    relative_entropy = (c * log2(m) - c' * log2(c')) / n

in bits a token (Ziv and Merhav 1993). Lower is likelier under the rest of the corpus.

An automaton of the corpus can't be held in one task, and parsing every document against
the automaton of every shard takes time in proportion to the square of the corpus. Here
the paths of the automaton are looked up instead, as hashes of runs in an index that is
divided by hash over all tasks; the phrases are those of the automaton. Runs of up to 8
tokens are asked for length by length (2, 3, 4, 6 and 8, then 5 and 7). Beyond, a match
that no other one holds can't be made longer on either side, so it begins where the
context of c tokens that begins there follows different tokens (or an end) in different
places of the corpus, and ends where the context that ends there is followed by
different ones; that is so in both texts. So with c = 8, 32, 128, ... contexts are asked
for along with the tokens on both sides, then the runs of c to 4 c tokens that begin and
end at such places. Where a longest match ends never moves back from one token to the
next, which gives all others.

Without ``exact`` only lengths of a ladder are looked up: 2, 3, 4, 6, 8, 12, 16, 24, 32,
48, ...: a longer match counts as the rungs that it is made of (a run of 1,000 tokens as
768, 192, 32 and 8).

How it works. Distinct texts are dealt by hash to batches of about ``BATCH`` bytes and
kept as tokens, which every round reads. In each round every batch asks for the distinct
runs of the round's lengths that may occur elsewhere (all of whose parts of the length
before do); a request goes to the part of the index that its hash belongs to, and comes
back with one bit: whether a second text asked for the same run. A batch asks for a run
once however often it holds it, so no run, document or group of copies makes a group
that grows with the corpus. After length 8 only the stretches that are shared are
carried on. Rounds end when nothing is left to ask for; their number grows with the
logarithm of the longest shared run. 64-bit hashes stand for runs, and 32 bits for the
tokens beside a context.

Edge cases: a text that is null or has no tokens has null scores, and 0 phrases. A
text that occurs in several rows occurs in another document as a whole: it is one
phrase. A null doc_id is scored like any other. Where there is no other text m counts
as 1 and every token is a phrase. Rows of one text score alike. Further columns aren't
read. No rows give no rows.
"""

from __future__ import annotations

import gc
import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.llm import text as T
from bough.llm.shared import shared_dir, spill

BATCH = 10_000_000
#: The last round in which batches are read from their texts; later ones read the stretches that are left.
_WHOLE = 3


def lengths(k: int) -> tuple[int, ...]:
    """Of round k, ascending."""
    if k < _WHOLE:
        return (k + 2,)
    if k == _WHOLE:
        return (6, 8)
    base = 8 << 2 * (k - _WHOLE - 1)
    return (base * 3 // 2, base * 2, base * 3, base * 4)


def own_phrases(tokens: list[int]) -> int:
    """Phrases of the incremental parsing; an unfinished last phrase counts."""
    root: dict = {}
    node, phrases = root, 0
    for x in tokens:
        after = node.get(x)
        if after is None:
            node[x] = {}
            phrases += 1
            node = root
        else:
            node = after
    return phrases + (node is not root)


def parsed(longest: list[int]) -> int:
    """Phrases of the greedy parsing, from the longest match that starts at each token."""
    at = phrases = 0
    end = len(longest)
    while at < end:
        at += longest[at] or 1
        phrases += 1
    return phrases


class Stretches:
    """Token runs of a batch: hashes, which stretch and text each token belongs to, its place in the batch, the longest match found, and whether the run of the last round's greatest length occurs elsewhere."""

    def __init__(self, h: np.ndarray, stretch: np.ndarray, text: np.ndarray, place: np.ndarray, longest: np.ndarray, alive: np.ndarray):
        self.h, self.stretch, self.text, self.place, self.longest, self.alive = h, stretch, text, place, longest, alive

    @classmethod
    def of(cls, row: np.ndarray, h: np.ndarray) -> Stretches:
        return cls(h, row, row, np.arange(len(h), dtype=np.int32), np.zeros(len(h), np.int32), np.ones(len(h), bool))

    def requests(self, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places of the runs, their hashes) of round k."""
        known = lengths(k - 1)[-1] if k else 1
        size = len(self.h)
        run = _reach(self.alive, self.stretch)
        power, inverse = T._power(T._MUL, size + 1), T._power(T._INV, size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(self.h * power[:size], out=total[1:])
        out = []
        for n in lengths(k):
            at = np.flatnonzero(run >= n - known + 1)
            out.append((n, at, T.mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n))))
        return out

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
        """The distinct hashes of round k, ascending, and which of them two texts of this batch have; then what fits answers to the runs."""
        asked = self.requests(k)
        key, first, order, group = _grouped(np.concatenate([x for _, _, x in asked]))
        return key, _several(self.text, np.concatenate([at for _, at, _ in asked]), order, first), [(n, at) for n, at, _ in asked], order, group

    def answer(self, k: int, there: np.ndarray) -> None:
        """Take in which of the distinct hashes of round k occur elsewhere."""
        key, _, asked, order, group = self.distinct(k)
        if len(there) != len(key):
            raise RuntimeError("answers don't fit the requests")
        found = np.empty(len(order), bool)
        found[order] = there[group]
        self.alive = np.zeros(len(self.h), bool)
        begin = 0
        for n, at in asked:
            hit = at[found[begin : begin + len(at)]]
            begin += len(at)
            self.longest[hit] = n
        self.alive[hit] = True

    def left(self, known: int) -> tuple[Stretches, bytes]:
        """The stretches that alive runs of the known length cover, and what was found elsewhere."""
        cover = np.zeros(len(self.h) + 1, np.int32)
        at = np.flatnonzero(self.alive)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + known, -1)
        covered = np.cumsum(cover[:-1]) > 0
        use = np.flatnonzero(covered)
        apart = np.concatenate([[True], (np.diff(use) > 1) | (self.stretch[use[1:]] != self.stretch[use[:-1]])]) if len(use) else np.zeros(0, bool)
        return Stretches(self.h[use], np.cumsum(apart).astype(np.int32), self.text[use], self.place[use], self.longest[use], self.alive[use]), _packed(rung=np.where(covered, 0, _rung(self.longest)).astype(np.uint8))

    def packed(self) -> bytes:
        begin = np.flatnonzero(np.concatenate([[True], self.stretch[1:] != self.stretch[:-1]])) if len(self.h) else np.zeros(0, np.int64)
        return _packed(begin=begin, size=np.array([len(self.h)]), place=self.place[begin], text=self.text[begin], **_coded(self.h))

    @classmethod
    def unpacked(cls, raw: bytes) -> Stretches:
        x = _unpacked(raw)
        size = np.diff(np.append(x["begin"], x["size"]))
        stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = (np.arange(len(stretch)) - x["begin"][stretch] + x["place"][stretch]).astype(np.int32)
        return cls(x["words"][_codes(x)], stretch, x["text"][stretch], place, np.zeros(len(stretch), np.int32), np.ones(len(stretch), bool))

    def progress(self) -> bytes:
        return _packed(rung=_rung(self.longest), alive=np.packbits(self.alive))

    def resume(self, raw: bytes) -> None:
        x = _unpacked(raw)
        self.longest, self.alive = _RUNGS[x["rung"]], np.unpackbits(x["alive"], count=len(self.h)).astype(bool)


def context(k: int) -> int:
    """Tokens of a context of round k of the matches."""
    return 8 << 2 * k


class Matches:
    """Token runs of a batch, for matches of every length: hashes, the stretch, text and place of each token, the longest match known to begin at it, and of the context that begins at it (``_SHARED``, ``_LEFT``, ``_RIGHT``)."""

    def __init__(self, h: np.ndarray, stretch: np.ndarray, text: np.ndarray, place: np.ndarray, low: np.ndarray, flags: np.ndarray):
        self.h, self.stretch, self.text, self.place, self.low, self.flags = h, stretch, text, place, low, flags

    def requests(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginnings and lengths of the runs that round k asks for, and beginnings of its contexts."""
        if k == 0:
            at = [np.flatnonzero(_reach(self.low >= n - 1, self.stretch) > 1) for n in (5, 7)]
            return np.concatenate(at), np.repeat([5, 7], [len(x) for x in at]), np.flatnonzero(self.low >= context(0))
        c = context(k - 1)
        run = _reach(self.flags & _SHARED > 0, self.stretch)
        a, b = np.flatnonzero(self.flags & _LEFT), np.flatnonzero(self.flags & _RIGHT)
        before = np.concatenate([[0], np.cumsum(self.flags & _RIGHT > 0)])
        first = before[a + 1]
        size = np.maximum(before[a + np.minimum(run[a], 3 * c)] - first, 0)
        at = np.repeat(a, size)
        last = b[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
        return at, last - at + c, np.flatnonzero(run > 3 * c)

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beginnings, lengths and hashes of the runs of round k, beginnings and hashes of its contexts."""
        at, n, begin = self.requests(k)
        size = len(self.h)
        power, inverse = T._power(T._MUL, size + 1), T._power(T._INV, size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(self.h * power[:size], out=total[1:])
        c = context(k)
        return at, n, T.mix((total[at + n] - total[at]) * inverse[at] + n.astype(np.uint64)), begin, T.mix((total[begin + c] - total[begin]) * inverse[begin] + np.uint64(c))

    def asked(self, k: int, parts: int) -> list[tuple[int, bytes, bytes]]:
        """(part of the index, hashes, what is known of each) of round k; contexts have parts of their own, after the others."""
        at, _, key, begin, around = self.hashes(k)
        key, first, order, _ = _grouped(key)
        several = _several(self.text, at, order, first)
        out = [(part, encoded(key[i:j]), np.packbits(several[i:j]).tobytes()) for part, i, j in _ranges(key, parts)]
        # the tokens on both sides of a context, in 32 bits; an end of a text or stretch is like no token
        key, first, order, _ = _grouped(around)
        known = [_several(self.text, begin, order, first)]
        begin = begin[order]
        inner = np.concatenate([[False], self.stretch[1:] == self.stretch[:-1], [False]]) if len(self.h) else np.zeros(1, bool)
        sides = []
        for edge, token in ((begin, begin - 1), (begin + context(k), begin + context(k))):
            side = np.where(inner[edge], self.h[token % max(1, len(self.h))] >> np.uint64(32), 0).astype(np.uint32) if len(begin) else np.zeros(0, np.uint32)
            apart = _differ(side, first)
            if len(first):
                apart |= np.logical_or.reduceat(~inner[edge], first)
            known.append(apart)
            sides.append(side[first])
        for part, i, j in _ranges(key, parts):
            out.append((parts + part, encoded(key[i:j]), b"".join([np.packbits(x[i:j]).tobytes() for x in known] + [x[i:j].tobytes() for x in sides])))
        return out

    def answered(self, k: int, there: np.ndarray) -> Matches:
        """After the answers to round k."""
        at, n, key, begin, around = self.hashes(k)
        runs, _, order, group = _grouped(key)
        contexts, _, order_, group_ = _grouped(around)
        if len(there) != len(runs) + len(contexts):
            raise RuntimeError("answers don't fit the requests")
        found = order[there[: len(runs)][group] > 0]
        low, flags = self.low.copy(), np.zeros(len(self.h), np.uint8)
        np.maximum.at(low, at[found], n[found].astype(np.int32))
        flags[begin[order_]] = there[len(runs) :][group_]
        low[flags & _SHARED > 0] = np.maximum(low[flags & _SHARED > 0], context(k))
        return Matches(self.h, self.stretch, self.text, self.place, low, flags)

    def left(self, k: int) -> tuple[Matches, bytes]:
        """The stretches that shared contexts of round k cover, and the matches that begin elsewhere."""
        cover = np.zeros(len(self.h) + 1, np.int32)
        at = np.flatnonzero(self.flags & _SHARED)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + context(k), -1)
        covered = np.cumsum(cover[:-1]) > 0
        # a match that ends no later than one that begins before it follows from that one
        end = (self.stretch.astype(np.int64) << 32) + np.arange(len(self.h)) + self.low
        rest = np.flatnonzero(~covered & (end > np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])) & (self.low > 1))
        use = np.flatnonzero(covered)
        apart = np.concatenate([[True], (np.diff(use) > 1) | (self.stretch[use[1:]] != self.stretch[use[:-1]])]) if len(use) else np.zeros(0, bool)
        return Matches(self.h[use], np.cumsum(apart).astype(np.int32), self.text[use], self.place[use], self.low[use], self.flags[use]), _packed(gap=np.diff(self.place[rest], prepend=np.int32(0)), low=self.low[rest])

    def packed(self) -> bytes:
        begin = np.flatnonzero(np.concatenate([[True], self.stretch[1:] != self.stretch[:-1]])) if len(self.h) else np.zeros(0, np.int64)
        return _packed(begin=begin, place=self.place[begin], text=self.text[begin], low=self.low, flags=self.flags, **_coded(self.h))

    @classmethod
    def unpacked(cls, raw: bytes) -> Matches:
        x = _unpacked(raw)
        size = np.diff(np.append(x["begin"], len(x["low"])))
        stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = (np.arange(len(stretch)) - x["begin"][stretch] + x["place"][stretch]).astype(np.int32)
        return cls(x["words"][_codes(x)], stretch, x["text"][stretch], place, x["low"], x["flags"])


#: Of a context: two texts have it; it comes after different tokens; different tokens come after it.
_SHARED, _LEFT, _RIGHT = 1, 2, 4


def _reach(alive: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Of each token how many tokens from it on are alive, within its stretch."""
    if not len(alive):
        return np.zeros(0, np.int64)
    stop = np.flatnonzero(np.concatenate([~alive[1:] | (stretch[1:] != stretch[:-1]), [True]]))
    run = np.repeat(stop + 1, np.diff(stop, prepend=-1)) - np.arange(len(alive))
    run[~alive] = 0
    return run


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, where each begins in the order that sorts them all, that order (equal ones as they come), and in that order which of the distinct ones each is."""
    if len(key):
        # sorting values takes a fraction of argsort's time, so places stand in the low bits, as few of the hashes' as their range allows
        least = key.min()
        place = np.uint64((1 << (len(key) - 1).bit_length()) - 1)
        order = (key - least << np.uint64(min(63, 64 - int(key.max() - least).bit_length()))) & ~place | np.arange(len(key), dtype=np.uint64)
        order.sort()
        order = (order & place).astype(np.int64)
        key = key[order]
        if (key[1:] < key[:-1]).any():  # some differ in those bits alone
            again = np.argsort(key, kind="stable")
            order, key = order[again], key[again]
    else:
        order = np.zeros(0, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return key[new], np.flatnonzero(new), order, np.cumsum(new) - 1


def _differ(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which groups have different values."""
    return np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first) if len(first) else np.zeros(0, bool)


def _several(text: np.ndarray, at: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which groups have runs of different texts; texts ascend with the places of the runs, so a group's first and last tell."""
    last = np.append(first[1:], len(order))[: len(first)] - 1
    return text[at[order[first]]] != text[at[order[last]]]


def _coded(h: np.ndarray) -> dict[str, np.ndarray]:
    """Token hashes as the distinct ones, most frequent first, and the bytes of each token's number among them, least first."""
    words, first, order, group = _grouped(h)
    by = np.argsort(-np.diff(first, append=len(h)), kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[by] = np.arange(len(words))
    code = np.empty(len(h), np.int32)
    code[order] = rank[group]
    return {"words": words[by], "code": np.ascontiguousarray(code.view(np.uint8).reshape(-1, 4).T)}


def _codes(x: dict[str, np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(x["code"].T).view(np.int32).ravel()


#: All lengths, after 0 for a token without a run.
_RUNGS = np.array([0, *(n for k in range(_WHOLE + 13) for n in lengths(k))], np.int32)


def _rung(longest: np.ndarray) -> np.ndarray:
    return np.searchsorted(_RUNGS, longest).astype(np.uint8)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return len(out.getbuffer()).to_bytes(8, "little") + pa.compress(out.getvalue(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))) as x:
        return {k: x[k] for k in x.files}


def encoded(key: np.ndarray) -> bytes:
    """Ascending hashes as differences of as many bytes as the greatest needs."""
    gap = np.diff(key, prepend=np.uint64(0))
    width = max(1, -(-int(gap.max()).bit_length() // 8))
    return bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decoded(raw: bytes) -> np.ndarray:
    width = raw[0]
    gap = np.zeros((len(raw) // width, 8), np.uint8)
    gap[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(gap.view(np.uint64).ravel(), dtype=np.uint64)


def _ranges(key: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part of the index, begin, end) of ascending hashes."""
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    return list(zip(part[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _table(path: str, batch: int, columns: list[str]) -> pa.Table | None:
    """The rows of a batch in a table that was written by batch."""
    system, root = fs.FileSystem.from_uri(path)
    files = [x.path for x in system.get_file_info(fs.FileSelector(f"{root}/batch={batch}", allow_not_found=True)) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=system, partitioning=None) for f in sorted(files)]) if files else None


def _tokenized(group: pa.Table) -> pa.Table:
    """A batch's texts as tokens, for all rounds."""
    row, h = T.words(group["text"], classes=T.TOKENS)
    body = _packed(h1=group["h1"].to_numpy(), h2=group["h2"].to_numpy(), size=np.bincount(row, minlength=group.num_rows), **_coded(h))
    return pa.table([group["batch"][:1].combine_chunks(), pa.array([body], pa.binary())], names=["batch", "body"])


def _tokens(texts: str, batch: int) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """Which text each token of a batch belongs to, and what _tokenized packed."""
    held = _table(texts, batch, ["body"])
    if held is None:
        return None
    x = _unpacked(held["body"][0].as_py())
    return np.repeat(np.arange(len(x["size"]), dtype=np.int32), x["size"]), x


#: Rows of a round's table that aren't answers: how far the batch was before the round; from the round after ``_WHOLE`` its stretches; what was found elsewhere.
_PROGRESS, _STRETCHES, _SETTLED = -1, -2, -3


def _held(path: str, batch: int, *parts: int) -> dict[int, bytes]:
    table = _table(path, batch, ["part", "body"])
    if table is None:
        return {}
    table = table.filter(pc.is_in(table["part"], pa.array(parts, pa.int32())) if parts else pc.greater_equal(table["part"], 0)).sort_by("part")
    return dict(zip(table["part"].to_pylist(), table["body"].to_pylist(), strict=True))


def _state(texts: str, told: list[str], batch: int) -> Stretches:
    """A batch after the rounds that were answered."""
    if len(told) <= _WHOLE + 1:
        row, x = _tokens(texts, batch) or (np.zeros(0, np.int32), None)
        s = Stretches.of(row, x["words"][_codes(x)] if x else np.zeros(0, np.uint64))
    else:
        s = Stretches.unpacked(_held(told[_WHOLE + 1], batch, _STRETCHES)[_STRETCHES])
    if told:
        s.resume(_held(told[-1], batch, _PROGRESS)[_PROGRESS])
        s.answer(len(told) - 1, _there(told[-1], batch).astype(bool))
    return s


def _there(path: str, batch: int) -> np.ndarray:
    """The answers to a round."""
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in _held(path, batch).values())])


def _asked(texts: str, told: list[str], parts: int, batch: int) -> pa.RecordBatch:
    """The requests of the next round, one row a part of the index, and how far the batch is."""
    s = _state(texts, told, batch)
    rest = []
    if len(told) == _WHOLE + 1:
        s, settled = s.left(lengths(_WHOLE)[-1])
        rest = [(_STRETCHES, s.packed()), (_SETTLED, settled)]
    rest.append((_PROGRESS, s.progress()))
    key, several, *_ = s.distinct(len(told))
    return _rows(batch, [(part, encoded(key[i:j]), np.packbits(several[i:j]).tobytes()) for part, i, j in _ranges(key, parts)], rest)


def _matched(texts: str, told: list[str], tried: list[str], parts: int, batch: int) -> pa.RecordBatch:
    """The requests of the next round of the matches, the stretches that are left and the matches that are known elsewhere."""
    k = len(tried)
    if k > 1:
        s = Matches.unpacked(_held(tried[-1], batch, _STRETCHES)[_STRETCHES])
    else:  # whole texts, which no round carries along
        x = _state(texts, told, batch)
        s = Matches(x.h, x.stretch, x.text, x.place, x.longest, np.zeros(len(x.h), np.uint8))
    if not k:
        return _rows(batch, s.asked(k, parts), [])
    s, settled = s.answered(k - 1, _there(tried[-1], batch)).left(k - 1)
    return _rows(batch, s.asked(k, parts), [(_STRETCHES, s.packed()), (_SETTLED, settled)])


def _rows(batch: int, asked: list[tuple[int, bytes, bytes]], rest: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [
        pa.array([batch] * (len(asked) + len(rest)), pa.int32()),
        pa.array([*(x for x, _, _ in asked), *(x for x, _ in rest)], pa.int32()),
        pa.array([*(x for x, _, _ in asked), *(-1 - batch for _ in rest)], pa.int32()),
        pa.array([*(x for _, x, _ in asked), *(x for _, x in rest)], pa.binary()),
        pa.array([*(x for _, _, x in asked), *(None for _ in rest)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["batch", "part", "to", "body", "several"])


def _answers(group: pa.Table, parts: int) -> pa.Table:
    """A part of the index: which of the hashes asked for by each batch two texts have, and of contexts which sides differ. Rows that ask for nothing stay."""
    if group["part"][0].as_py() < 0:
        return group.select(["batch", "part", "body"])
    contexts = group["part"][0].as_py() >= parts
    keys = [decoded(x) for x in group["body"].to_pylist()]
    sizes = [len(x) for x in keys]
    known = list(zip(group["several"].to_pylist(), sizes, strict=True))
    bits = lambda i: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -(-n // 8), i * -(-n // 8)), count=n) for x, n in known])[order]
    key = np.concatenate(keys)
    _, first, order, group_ = _grouped(key)
    there = (np.maximum.reduceat(bits(0), first) > 0).astype(np.uint8)
    there[np.diff(first, append=len(key)) > 1] = 1
    if contexts:
        for i, flag in enumerate((_LEFT, _RIGHT)):
            side = np.concatenate([np.frombuffer(x, np.uint32, n, 3 * -(-n // 8) + 4 * i * n) for x, n in known])[order]
            there |= np.where(there & _SHARED, flag * (_differ(side, first) | (np.maximum.reduceat(bits(1 + i), first) > 0)), 0).astype(np.uint8)
    out = np.empty(len(key), np.uint8)
    out[order] = there[group_]
    return pa.table([group["batch"], group["part"], pa.array([x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], pa.binary())], names=["batch", "part", "body"])


def _scores(texts: str, told: list[str], tried: list[str], batch: int) -> pa.RecordBatch | None:
    """(h1, h2, tokens, phrases, own) of a batch's texts."""
    held = _tokens(texts, batch)
    if held is None:
        return None
    row, held = held
    longest = np.zeros(len(row), np.int32)
    if tried:
        for path in tried[1:]:
            x = _unpacked(_held(path, batch, _SETTLED)[_SETTLED])
            place = np.cumsum(x["gap"])
            longest[place] = np.maximum(longest[place], x["low"])
        end = np.maximum.accumulate(np.arange(len(row)) + longest) if len(row) else np.zeros(0, np.int64)  # no match ends in the next text
        longest = end - np.arange(len(row))
    else:
        s = _state(texts, told, batch)
        if len(told) > _WHOLE + 1:
            longest = _RUNGS[_unpacked(_held(told[_WHOLE + 1], batch, _SETTLED)[_SETTLED])["rung"]]
        longest[s.place] = s.longest
    n, code = held["size"], _codes(held)
    at = np.concatenate([[0], np.cumsum(n)]).tolist()
    c, own = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        c.append(parsed(longest[a:b].tolist()))
        own.append(own_phrases(code[a:b].tolist()))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (held["h1"], held["h2"], n, c, own)], ["h1", "h2", "tokens", "phrases", "own"])


def _once(batches):
    """Rows of texts that this task hasn't given yet."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True))
        fresh = []
        for k in keys:
            fresh.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(fresh))


def score(docs: DataFrame, batch: int = BATCH, exact: bool = False) -> DataFrame:
    """(doc_id, tokens, phrases, cross_entropy, relative_entropy) for every row; if exact, phrases are the longest matches, else the longest of the ladder's lengths."""
    spark = docs.sparkSession
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text"))
    text = text.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    ids = spill(text.select("doc_id", F.when(F.col("text").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("text").isNotNull(), F.col("h2")).alias("h2"), F.octet_length("text").alias("bytes")))
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-size // batch))
    folder = f"{shared_dir(spark)}/parsing-{uuid.uuid4().hex}"
    # each task gives a text once, so that copies don't meet in one task as texts
    key = F.pmod("h1", F.lit(parts)).cast("int").alias("batch")
    once = text.where("text is not null").select("h1", "h2", "text").mapInArrow(_once, "h1 long, h2 long, text string").select(key, "*")
    texts = f"{folder}/texts"
    tokens = once.repartition("batch").dropDuplicates(["batch", "h1", "h2"]).groupBy("batch").applyInArrow(_tokenized, "batch int, body binary")
    tokens.write.partitionBy("batch").option("compression", "none").parquet(texts)
    del tokens
    _tidy(spark)
    batches = spark.range(0, parts, 1, parts)

    def each(f, *args):
        def run(rows):
            for x in rows:
                for b in x.column(0).to_pylist():
                    if (out := f(*args, b)) is not None:
                        yield out

        return run

    def answered(path: str, f, *args) -> bool:
        """Write the answers to a round; whether anything was asked for."""
        asked = batches.mapInArrow(each(f, *args), "batch int, part int, to int, body binary, several binary")
        out = asked.groupBy("to").applyInArrow(lambda group: _answers(group, parts), "batch int, part int, body binary")
        out.repartition("batch").write.partitionBy("batch").option("compression", "zstd").parquet(path)
        del asked, out
        _tidy(spark)
        return not spark.read.schema("batch int, part int, body binary").parquet(path).where("part >= 0").isEmpty()

    told: list[str] = []
    more = True
    while more and not (exact and len(told) > _WHOLE):
        told.append(f"{folder}/told-{len(told)}")
        more = answered(told[-1], _asked, texts, told[:-1], parts)
        if more and len(told) > 1 and len(told) != _WHOLE + 3:  # that one has the stretches
            _drop(spark, told[-2])
    tried: list[str] = []
    more = exact
    while more or len(tried) == 1:  # what the first round knows is in the second
        tried.append(f"{folder}/tried-{len(tried)}")
        more = answered(tried[-1], _matched, texts, told, tried[:-1], parts)
    scores = spill(batches.mapInArrow(each(_scores, texts, told, tried), "h1 long, h2 long, tokens long, phrases long, own long"))
    _drop(spark, folder)
    m = scores.agg(F.sum("tokens")).first()[0] or 0
    copies = ids.where("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    light = scores.join(copies, ["h1", "h2"]).withColumn("phrases", F.when(F.col("tokens") > 0, F.when(F.col("copies") > 1, 1).otherwise(F.col("phrases"))).otherwise(0).cast("long"))
    cross = F.col("phrases") * F.log2(F.greatest(F.lit(m) - F.col("tokens"), F.lit(1)))
    light = light.withColumn("cross", F.when(F.col("tokens") > 0, cross))
    out = ids.select("doc_id", "h1", "h2").join(light, ["h1", "h2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("phrases", zero).alias("phrases"),
        (F.col("cross") / F.col("tokens")).alias("cross_entropy"),
        ((F.col("cross") - F.col("own") * F.log2("own")) / F.col("tokens")).alias("relative_entropy"),
    )


def _tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds that are over, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
