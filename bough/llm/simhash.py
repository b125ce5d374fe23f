"""SimHash near-duplicates, found with pigeonring chains.

A document's fingerprint has 320 bits: the signs of the sums of the +-1 hash
vectors of its distinct words. Two documents are near copies if their
fingerprints differ in at most ``most`` bits (48: 15 %).

The bits form a ring of 16 segments of 20 bits. If two fingerprints differ in at
most ``most`` bits, then the ring has a start from which every chain of l
consecutive segments differs in at most l * most / 16 bits (the pigeonring
principle). A document meets those that differ from it in at most two bits of a
segment (``PROBED``); of these pairs a start is required that keeps its budget, chain
length by chain length, before the full Hamming check. A pair of at most 48 bits that
meets in no segment differs in 3 bits of each; so the parities of all its segments
differ, and it meets among documents of opposite parities. So every pair is found.

A task holds the segments of one place on the ring that begin with the same
``TOP`` bits, and those that lead there by one or two of these bits; so a document is
sent to 3.25 tasks a segment on average, and other neighbours are looked up within the
task: those of one bit as such, those of two where both have a neighbour of one bit in
common. Pairs that are in one group already aren't compared again: each task gives
edges that span its groups, not all pairs, and a bucket of many copies costs time
in proportion to its size. Nothing is capped or dropped. How many pairs meet by chance
grows with the square of the corpus; such a pair costs two rows' lookup and eight words'
comparison, as half of the ring settles it.

Edge cases: a null or empty text, or one without words, has no fingerprint and no
copies. Rows without doc_id aren't compared and stay. Rows that repeat a doc_id
are one document: they count as a copy of it only within ``keep_one``, which
keeps the row with the least text. Other columns, whatever their names, pass
through unread. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bough.llm import text as T
from bough.llm.shared import components, spill

SEGMENTS, HALF = 16, 10
BITS = SEGMENTS * HALF * 2
MOST = 48
#: Bits of a segment that may differ where two documents meet.
PROBED = 2
#: Leading bits of a segment that settle the task; more for more than 2 ** 20 documents.
TOP = 3
_PAIRS = 1 << 16
#: Rows of a bucket up to which its groups aren't told apart before pairs are made.
_SMALL = 16
_WORDS = BITS // 64
_SEEDS = T.mix(np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: One byte's bits as eight byte-wide counters.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_PART = 255
_ROW_BITS = 24


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their fingerprints as (n, 40) bytes."""
    row, h = T.words(column)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8)
    bits = _ROW_BITS  # the same for every batch: a fingerprint depends on the text alone
    if int(row[-1]) >> bits:
        raise ValueError("too many rows in one batch")
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row = (key >> np.uint64(64 - bits)).astype(np.int64)
    h = key << np.uint64(bits)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(begin, len(row)))
    # counters of one byte: sum runs of at most 255 words, then the runs
    runs = -(-size // _PART)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(begin, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * _PART
    total = np.zeros((len(begin), BITS), np.int64)
    step = max(1, 4096 // _PART)
    parts = []
    ends = np.append(at[1:], len(h))
    for i in range(0, len(at), step * 4):
        j = min(len(at), i + step * 4)
        part = h[at[i] : ends[j - 1]]
        lanes = _LANES[T.mix(part[:, None] ^ _SEEDS[None, :]).view(np.uint8)]
        parts.append(np.add.reduceat(lanes, at[i:j] - at[i], axis=0).view(np.uint8).astype(np.uint32))
    total = np.add.reduceat(np.concatenate(parts), first, axis=0)
    return row[begin], np.packbits(2 * total > size[:, None], axis=1)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0 .. f4): a row for each row that has a doc_id and words."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, fp = fingerprints(part.column("text"))
        longs = np.ascontiguousarray(fp).view("<i8").reshape(-1, _WORDS)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(_WORDS))], ["doc_id", *(f"f{k}" for k in range(_WORDS))])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    return rows.mapInArrow(T.in_slices(run), "doc_id long, " + ", ".join(f"f{k} long" for k in range(_WORDS)))


def halves(longs: np.ndarray) -> np.ndarray:
    """(n, 5) longs to (n, 32) half segments."""
    bits = np.unpackbits(np.ascontiguousarray(longs).view(np.uint8).reshape(-1, BITS // 8), axis=1).reshape(-1, 2 * SEGMENTS, HALF)
    return (bits * (1 << np.arange(HALF, dtype=np.uint16))).sum(axis=2, dtype=np.uint16)


def segments(half: np.ndarray) -> np.ndarray:
    """(n, 16) segments of 20 bits."""
    return half[:, 0::2].astype(np.int64) | (half[:, 1::2].astype(np.int64) << HALF)


def parity(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of segments the parities of all but the first, alike in rows all of whose parities differ; and the first's, by which these are told apart."""
    odd = np.bitwise_count(value) & 1
    side = odd[:, 0] > 0
    return ((odd[:, 1:] ^ side[:, None]).astype(np.int64) << np.arange(SEGMENTS - 1)).sum(axis=1), side


def chained(a: np.ndarray, b: np.ndarray, most: int = MOST) -> np.ndarray:
    """Which of the pairs of half segments (n, 32) differ in at most ``most`` bits, by chains of growing length; most pairs differ in more in half of the ring, which is looked at as a whole first."""
    d = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).view(np.uint64).ravel() & np.uint64(0xFFFFFFFF)  # four counts of 40 bits, a byte each
    left = np.flatnonzero((d * np.uint64(0x01010101)) >> np.uint64(24) & np.uint64(255) <= most)
    d = np.bitwise_count(a[left] ^ b[left])
    seg = (d[:, 0::2] + d[:, 1::2]).astype(np.int16)
    total = np.zeros_like(seg)
    viable = np.ones(seg.shape, bool)
    for length in range(1, SEGMENTS + 1):  # the last length is the full Hamming distance
        total += np.roll(seg, -(length - 1), axis=1)
        viable &= total * SEGMENTS <= length * most
        go = viable.any(axis=1)
        if not go.all():
            left, seg, total, viable = left[go], seg[go], total[go], viable[go]
    return left


class Joined:
    """Groups of rows, as labels; joins give the edges that span them."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the edges (a, b) join two groups."""
        pairs = np.stack([self.label[a], self.label[b]], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = top.get(y, y)
                x = y
            return x

        use = []
        for k, (x, y) in zip(first.tolist(), pairs[first].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = min(x, y)
                use.append(k)
        if use:
            to = np.arange(len(self.label))
            for x in list(top):
                to[x] = find(x)
            self.label = to[self.label]
        return np.array(use, np.int64)


def linked(value: np.ndarray, home: np.ndarray, target: np.ndarray, half: np.ndarray, low: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of near copies among rows of one task.

    value: the rows' segments; home: which rows others are compared with; target: of
    the other rows the segment they are compared with. Rows at home are compared with
    those of their own segment and of those that differ in one or two of the ``low`` low
    bits; others with those at home that differ from them in up to two bits, and with
    each other where they differ in two of the high ones.
    """
    groups = Joined(len(value))
    at_home = np.flatnonzero(home)
    bit = 1 << np.arange(low)
    # rows by their rank among rows alike: the first of every bucket go first and join most of it
    rank = _ranks((target << 1) | home)
    out = []
    for k in range(int(rank.max()).bit_length() + 1):
        now = np.flatnonzero((rank >= (1 << k) >> 1) & (rank < 1 << k))
        mine = now[home[now]]
        rows, to = [now], [target[now]]
        for b in range(low):
            low_row = mine[(value[mine] >> b) & 1 == 0] if k == 0 else mine
            rows.append(low_row)
            to.append(value[low_row] ^ (1 << b))
        out += _compared(np.concatenate(rows), np.concatenate(to), at_home, value[at_home], groups, half, most)
    # two rows two bits apart meet where each is one bit away
    beside = np.flatnonzero(~home & (np.bitwise_count((value ^ target) >> low) == 1))
    row = np.concatenate([np.repeat(at_home, low), beside])
    to = np.concatenate([(value[at_home][:, None] ^ bit).ravel(), target[beside]])
    rank = _ranks(to)
    for k in range(int(rank.max()).bit_length() + 1 if len(rank) else 0):
        now = np.flatnonzero((rank >= (1 << k) >> 1) & (rank < 1 << k))
        seen = np.flatnonzero(rank < 1 << k) if k else now[:0]  # each pair once: with those of lesser or like rank
        out += _compared(row[now], to[now], row[seen], to[seen], groups, half, most)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(b for _, b in out)])


def opposed(key: np.ndarray, side: np.ndarray, half: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of near copies among rows of the same key on different sides."""
    groups = Joined(len(key))
    there = np.flatnonzero(side)
    rank = _ranks((key << 1) | side)
    out = []
    for k in range(int(rank.max()).bit_length() + 1):
        now = np.flatnonzero(~side & (rank >= (1 << k) >> 1) & (rank < 1 << k))
        out += _compared(now, key[now], there, key[there], groups, half, most)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(b for _, b in out)])


def _ranks(key: np.ndarray) -> np.ndarray:
    """Of each row how many rows before it have its key."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank


def _compared(row: np.ndarray, to: np.ndarray, member: np.ndarray, held: np.ndarray, groups: Joined, half: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join groups, of rows with the members held where they look, as far as those are of other groups."""
    if not len(row):
        return []
    key = (held << 32) | groups.label[member]
    sort = np.argsort(key, kind="stable")
    key, held, member = key[sort], held[sort], member[sort]
    least = int(to.min())
    at = np.searchsorted(held, np.arange(least, int(to.max()) + 2))  # where each bucket begins
    begin, end = at[to - least], at[to - least + 1]
    some = end > begin
    row, to, begin, end = row[some], to[some], begin[some], end[some]
    large = end - begin > _SMALL  # of others what is of the row's own group is left out pair by pair
    own = (to[large] << 32) | groups.label[row[large]]
    first, size = [begin[~large], begin[large]], [(end - begin)[~large]]
    low, high = np.searchsorted(key, own), np.searchsorted(key, own + 1)
    row = np.concatenate([row[~large], row[large], row[large]])
    first, size = np.concatenate([*first, high]), np.concatenate([*size, low - begin[large], end[large] - high])
    row, first, size = row[size > 0], first[size > 0], size[size > 0]
    done = np.concatenate([[0], np.cumsum(size)])
    out = []
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(done, done[i] + _PAIRS, "right")) - 1)
        a = np.repeat(row[i:j], size[i:j])
        b = member[np.arange(len(a)) - np.repeat(done[i:j] - done[i], size[i:j]) + np.repeat(first[i:j], size[i:j])]
        i = j
        apart = groups.label[a] != groups.label[b]
        a, b = a[apart], b[apart]
        near = chained(half.take(a, axis=0), half.take(b, axis=0), most)
        if len(near):
            a, b = a[near], b[near]
            use = groups.join(a, b)
            out.append((a[use], b[use]))
    return out


def near_edges(prints: DataFrame, most: int = MOST, top: int | None = None) -> DataFrame:
    """(a, b): edges between near copies among rows of distinct fingerprints (doc_id, f0 .. f4); they span the groups that all near pairs found would give."""
    if most > 3 * SEGMENTS:
        raise ValueError(f"pairs of more than {3 * SEGMENTS} bits may meet nowhere")
    if top is None:
        top = max(TOP, (prints.count() >> 20).bit_length() + TOP)
    fields = "doc_id long, " + ", ".join(f"f{k} long" for k in range(_WORDS))
    low = 2 * HALF - top

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                piece = batch.slice(at, 1 << 13)
                value = segments(halves(np.stack([piece.column(f"f{k}").to_numpy() for k in range(_WORDS)], axis=1)))
                part = (np.arange(SEGMENTS) << top) | (value >> low)
                row, parts = [np.repeat(np.arange(piece.num_rows), SEGMENTS)], [part.ravel()]
                for i in range(top):  # of two neighbours the one with a 0 visits the other
                    for bit in {1 << i} | {1 << i | 1 << j for j in range(i)}:
                        r, s = np.nonzero(part & bit == 0)
                        row.append(r)
                        parts.append(part[r, s] | bit)
                row.append(np.arange(piece.num_rows))
                parts.append(SEGMENTS << top | parity(value)[0] >> (SEGMENTS - 1 - top))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).astype(np.int32)), *(piece.column(c).take(take) for c in piece.schema.names)], ["part", *piece.schema.names])

    def meet(group: pa.Table) -> pa.Table:
        part, doc = group["part"][0].as_py(), group["doc_id"].to_numpy()
        half = halves(np.stack([group[f"f{k}"].to_numpy() for k in range(_WORDS)], axis=1))
        here = part >> top
        if here == SEGMENTS:
            a, b = opposed(*parity(segments(half)), half, most)
            return pa.table([pa.array(doc[a]), pa.array(doc[b])], names=["a", "b"])
        value = segments(half[:, 2 * here : 2 * here + 2])[:, 0]
        begin = (part & ((1 << top) - 1)) << low
        target = begin | (value & ((1 << low) - 1))
        a, b = linked(value, target == value, target, half, low, most)
        return pa.table([pa.array(doc[a]), pa.array(doc[b])], names=["a", "b"])

    rows = prints.select("doc_id", *(f"f{k}" for k in range(_WORDS))).mapInArrow(send, "part int, " + fields)
    return rows.groupBy("part").applyInArrow(meet, "a long, b long")


def copies(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, duplicate_of): each document that has a near copy of lesser doc_id in its group, with the group's least."""
    words = [f"f{k}" for k in range(_WORDS)]
    least = prints.groupBy(*words).agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy(*words)
    same = prints.select("doc_id", *words).withColumn("least", F.min("doc_id").over(w)).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    found = components(near_edges(least, most).unionByName(same))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of"))


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, duplicate_of) for the documents that are near copies of another; see the module's text."""
    return copies(spill(fingerprint_table(docs)), most)


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs with one document of each group of near copies: the one of least doc_id."""
    prints = spill(fingerprint_table(docs))
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))  # no name of docs' can clash with one used here
    dropped = copies(prints, most).select(F.col("doc_id").alias("id"))
    rest = row.join(dropped, F.col("row.doc_id") == F.col("id"), "left_anti")
    again = prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    once = rest.join(again, F.col("row.doc_id") == F.col("id"), "left_anti")
    twice = rest.join(again, F.col("row.doc_id") == F.col("id"), "left_semi")
    w = Window.partitionBy("row.doc_id").orderBy("row.text")
    out = once.unionByName(twice.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
