"""Benchmark decontamination by latent semantic retrieval.

Items of the benchmark are cut into passages of at most ``PASSAGE`` words. Words are
weighted by sqrt(tf) * idf over hashed features; document frequencies are counted over
all documents. A distributed randomised SVD of the passages' TF-IDF matrix (random
range finder, Gram matrices summed over partitions, at most ``RANK`` dimensions)
gives the latent space. Every window of 32 words of every document (starting 16
apart) is folded in, and its cosine with each passage decides the candidates.

A window and a passage are compared only if verification could accept them, which two
counts settle without loss: of the passage's rarest words (all but the ``LCS`` of its
words that may go unmatched, and ``SURELY`` of these) as many must lie around the
window as cannot be missing, and then of all its words, each as often as the passage
has it, ``LCS`` of its size. Windows without such a passage aren't folded in. How the
window's weight divides between the passages' vocabulary and other words plays no
part, so items that many documents quote, whose words weigh little, are found like
others.

A candidate counts if the longest common subsequence of the passage and the words
around the window has ``LCS`` (0.5) of the passage's words and as much of its answer,
the last quarter of its words; or ``SURE`` (0.8) of the passage whatever the answer. So
paraphrases with words put in, left out or exchanged are found.

A benchmark of more than ``SPACE_WORDS`` words is searched in several latent spaces,
one pass each, so that what travels to the executors stays bounded.

Edge cases: items without item_id, text or words, and documents without text, match
nothing. Items that repeat an item_id are pooled: the best passage counts. Documents
without doc_id are searched too (their matches carry a null); rows that repeat give
equal matches. Windows at a text's end are shorter. An empty benchmark leaves all
documents clean; no documents give no rows. Further columns pass through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.llm import text as T

BITS, BLOCK = 18, 16
PASSAGE, RANK, SPACE_WORDS = 64, 256, 1 << 15
COSINE, LCS, SURE = 0.4, 0.5, 0.8
#: Share of the words that must match which are looked for by the first count.
SURELY = 0.4


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every feature, over all documents that have text: ln((N + 1) / (df + 1)) + 0.1."""

    def run(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                row, h = T.words(part.column("text"))
                key = np.sort((row.astype(np.int64) << BITS) | _feature(h))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                total += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
                n += part.num_rows
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["feature", "n"])

    counted = docs.where(docs["text"].isNotNull()).select(F.lower(docs["text"]).alias("text")).mapInArrow(run, "feature int, n long")
    got = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BITS + 1 rows at most
    feature, n = got["feature"].to_numpy(), got["n"].to_numpy()
    df, size = np.zeros(1 << BITS), int(n[feature == -1].sum())
    df[feature[feature >= 0]] = n[feature >= 0]
    return (np.log((size + 1) / (df + 1)) + 0.1).astype(np.float32)


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, words): each item's passages as word hashes."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, h = T.words(part.column("text"))
        item = part.column("item_id").to_pylist()
        out = []
        for r in range(part.num_rows):
            own = h[np.searchsorted(row, r, "left") : np.searchsorted(row, r, "right")].view(np.int64)
            pieces = -(-len(own) // PASSAGE)
            out += [(item[r], k, piece) for k, piece in enumerate(np.array_split(own, pieces) if pieces else [])]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["item_id", "part", "words"])

    rows = benchmark.where(benchmark["item_id"].isNotNull() & benchmark["text"].isNotNull()).select(benchmark["item_id"].cast("long").alias("item_id"), F.lower(benchmark["text"]).alias("text"))
    return rows.mapInArrow(T.in_slices(run), "item_id long, part int, words array<long>")


def _weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, n = np.unique(_feature(words.view(np.uint64)), return_counts=True)
    return f, np.sqrt(n) * idf[f]


def _gauss(f: np.ndarray, size: int) -> np.ndarray:
    """Rows of the random test matrix, a function of the feature."""
    bits = T.mix((f.astype(np.uint64)[:, None] << np.uint64(12)) + np.arange(2 * size, dtype=np.uint64)[None, :] + np.uint64(1))
    u = (bits >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-12
    return np.sqrt(-2 * np.log(u[:, :size])) * np.cos(2 * np.pi * u[:, size:])


def _matrix_sum(df: DataFrame, size: int) -> np.ndarray:
    """Sum of (size, size) matrices that a function gives as rows (i, values)."""
    got = df.groupBy("i").agg(*(F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(size))).toArrow() if size <= 64 else df.select("i", F.posexplode("v")).groupBy("i", "pos").agg(F.sum("col").alias("s")).toArrow()
    out = np.zeros((size, size))
    if size <= 64:
        for k in range(size):
            out[got["i"].to_numpy(), k] = got[f"s{k}"].to_numpy()
    else:
        out[got["i"].to_numpy(), got["pos"].to_numpy()] = got["s"].to_numpy()
    return out


def _rows_of(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], ["i", "v"])


def svd(table: DataFrame, idf: np.ndarray, rank: int = RANK, over: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the passages' TF-IDF matrix: features with any weight, sorted, and (features, k)."""
    size = min(rank, table.count()) + over
    if size == over:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)

    def sketch(words) -> np.ndarray:
        f, w = _weighted(words, idf)
        return w @ _gauss(f, size)

    def each(batches):
        for batch in batches:
            yield from (x.values.to_numpy() for x in batch.column("words"))

    def gram(batches):
        y = np.array([sketch(x) for x in each(batches)]).reshape(-1, size)
        yield _rows_of(y.T @ y)

    values, vectors = np.linalg.eigh(_matrix_sum(table.select("words").mapInArrow(gram, "i int, v array<double>"), size))
    good = values > values.max() * 1e-10
    to_q = vectors[:, good] / np.sqrt(values[good])

    def project(batches):
        total: dict[int, np.ndarray] = {}
        for x in each(batches):
            f, w = _weighted(x, idf)
            q = (w @ _gauss(f, size)) @ to_q
            for k, v in zip(f.tolist(), w.tolist(), strict=True):
                total[k] = total[k] + v * q if k in total else v * q
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["feature", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("feature").to_pylist(), batch.column("v"), strict=True):
                v = v.values.to_numpy()
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["feature", "v"])

    schema = "feature long, v array<double>"
    b = table.select("words").mapInArrow(project, schema).repartition("feature").mapInArrow(add, schema).toArrow()  # SPACE_WORDS features at most
    feature = b["feature"].to_numpy()
    m = np.array([x.values.to_numpy() for x in b["v"]])
    order = np.argsort(feature)
    feature, m = feature[order], m[order]
    values, vectors = np.linalg.eigh(m.T @ m)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > values.max() * 1e-10]
    return feature, (m @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)


def places(a: list[int]) -> dict[int, int]:
    """Of each word of a, the bits of its positions."""
    out: dict[int, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def common(at: dict[int, int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence of the ``size`` words with these places and of b, by bit-parallel dynamic programming."""
    full = (1 << size) - 1
    v = full
    for y in b:
        if u := v & at.get(y, 0):
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs(a: list[int], b: list[int]) -> int:
    return common(places(a), len(a), b)


@dataclass
class Space:
    """A latent space and the passages in it."""

    idf: np.ndarray
    feature: np.ndarray
    vectors: np.ndarray
    items: list[int]
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.at = np.full(1 << BITS, -1, np.int32)
        self.at[self.feature] = np.arange(len(self.feature))
        lists = [x.tolist() for x in self.words]
        self.sizes = [len(x) for x in lists]
        answers = [x[-max(1, len(x) // 4) :] for x in lists]
        self.answer_sizes = [len(x) for x in answers]
        self.places, self.answer_places = [places(x) for x in lists], [places(x) for x in answers]
        self._index()
        rows = np.repeat(np.arange(len(self.words)), [len(x) for x in self.words])
        self.coordinates = self.fold(rows, _feature(np.concatenate(self.words).view(np.uint64)) if self.words else np.zeros(0, np.int64), len(self.words))

    def fold(self, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """Unit coordinates of rows of features; 0 where nothing lies in the space."""
        known = self.at[f] >= 0
        key, count = np.unique((row[known].astype(np.int64) << BITS) | f[known], return_counts=True)
        out = np.zeros((n, self.vectors.shape[1]), np.float32)
        if len(key):
            f, row = key & ((1 << BITS) - 1), key >> BITS
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[begin]] = np.add.reduceat(self.vectors[self.at[f]] * (np.sqrt(count) * self.idf[f])[:, None].astype(np.float32), begin, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _index(self) -> None:
        """For the two counts: the passages' words, their number in each passage, and of each passage its rarest words."""
        self.length = np.array(self.sizes, np.int64)
        self.need = np.ceil(LCS * self.length).astype(np.int64)
        self.rare = np.maximum(1, (SURELY * self.need).astype(np.int64))
        words = [x.view(np.uint64) for x in self.words]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        key, owner, rank = [], [], []
        for k, x in enumerate(words):
            place = np.searchsorted(self.vocabulary, x)
            rarest = np.unique(place[np.lexsort((x, -self.idf[_feature(x)]))[: self.length[k] - self.need[k] + self.rare[k]]])
            rank.append(rarest * len(words) + k)
            own, count = np.unique(place, return_counts=True)
            key.append(own * len(words) + k)
            owner.append(count)
        none = np.zeros(0, np.int64)
        order = np.argsort(key := np.concatenate([none, *key]))
        self.pair, self.count = key[order], np.concatenate([none, *owner])[order]  # (word, passage), ascending, and how often
        rarest = np.sort(np.concatenate([none, *rank]))
        self.owners = rarest % max(1, len(words))
        self.first = np.searchsorted(rarest, np.arange(len(self.vocabulary) + 1) * len(words))

    def _candidates(self, row: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, base: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and passages that both counts leave. start, end, first, last: of the windows and of their rows; base, begin: of each word its row's first window and word."""
        known = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.vocabulary, h[known]), len(self.vocabulary) - 1)
        true = self.vocabulary[word] == h[known]
        known, word = known[true], word[true]
        many = self.first[word + 1] - self.first[word]
        at = np.repeat(known, many)
        passage = self.owners[np.repeat(self.first[word], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        order = np.argsort((passage << 32) | at)
        at, passage = at[order], passage[order]
        one = np.arange(len(at))
        to = one + self.rare[passage] - 1
        one, to = one[to < len(at)], to[to < len(at)]
        near = (passage[to] == passage[one]) & (row[at[to]] == row[at[one]]) & (at[to] - at[one] < 2 * BLOCK + 2 * self.length[passage[one]])
        low, high, passage = at[one[near]], at[to[near]], passage[one[near]]
        size = self.length[passage]
        a = np.maximum(0, -((begin[low] + size + 2 * BLOCK - 1 - high) // BLOCK))
        b = np.minimum((low + size - begin[low]) // BLOCK, (last[base[low]] - begin[low] - 1) // BLOCK)
        many = np.maximum(0, b - a + 1)
        window = np.repeat(base[low] + a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = np.unique((window << 32) | np.repeat(passage, many))
        window, passage = key >> 32, key & 0xFFFFFFFF
        held = np.searchsorted(known, np.stack([np.maximum(first[window], start[window] - self.length[passage]), np.minimum(last[window], end[window] + self.length[passage])]))
        total = np.zeros(len(window), np.int64)
        for i in range(0, len(window), 1 << 14):
            low, size = held[0, i : i + (1 << 14)], (held[1] - held[0])[i : i + (1 << 14)]
            own = np.repeat(np.arange(len(low)), size)
            here = word[np.repeat(low, size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)]
            pair = here * len(self.sizes) + passage[i : i + (1 << 14)][own]
            found = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            true = self.pair[found] == pair
            key, seen = np.unique(own[true] * len(self.pair) + found[true], return_counts=True)
            owner = key // len(self.pair)
            total[i : i + (1 << 14)] += np.bincount(owner, np.minimum(seen, self.count[key % len(self.pair)]), len(low)).astype(np.int64)
        good = total >= self.need[passage]
        return window[good], passage[good]

    def search(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """Verified matches: (row, item_id) to (cosine, share of the passage, share of its answer)."""
        row, h = T.words(column)
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(h) or not self.items:
            return out
        f = _feature(h)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(begin, len(row)))
        per = -(-size // BLOCK)
        first, last = np.repeat(begin, per), np.repeat(begin + size, per)
        base = np.cumsum(per) - per
        start = first + (np.arange(per.sum()) - np.repeat(base, per)) * BLOCK
        end = np.minimum(start + 2 * BLOCK, last)
        window, passage = self._candidates(row, h, start, end, first, last, np.repeat(base, size), np.repeat(begin, size))
        for i in range(0, len(window), 4096):
            now, inside = np.unique(window[i : i + 4096], return_inverse=True)
            length = end[now] - start[now]
            at = np.repeat(start[now], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            unit = self.fold(np.repeat(np.arange(len(now)), length), f[at], len(now))
            cosine = np.einsum("ij,ij->i", unit[inside], self.coordinates[passage[i : i + 4096]])
            for k in np.flatnonzero(cosine >= COSINE).tolist():
                w, p = int(window[i + k]), int(passage[i + k])
                n = self.sizes[p]
                around = h[max(first[w], start[w] - n) : min(last[w], end[w] + n)].view(np.int64).tolist()
                at_p = self.places[p]
                around = [x for x in around if x in at_p]  # other words play no part in a common subsequence
                share = common(at_p, n, around) / n
                if share < LCS:
                    continue
                answered = common(self.answer_places[p], self.answer_sizes[p], around) / self.answer_sizes[p]
                if answered >= LCS or share >= SURE:
                    key, found = (int(row[start[w]]), self.items[p]), (float(cosine[k]), share, answered)
                    if key not in out or found[1:] > out[key][1:]:
                        out[key] = found
        return out


def spaces(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> list[Space]:
    """The latent spaces of the benchmark: one, or more where it is large."""
    from bough.llm.shared import spill

    table = spill(passages(benchmark))
    words = table.agg(F.sum(F.size("words"))).first()[0] or 0
    if not words:
        return []
    idf = inverse_frequencies(docs)
    parts = -(-words // SPACE_WORDS)
    out = []
    for k in range(parts):
        mine = table.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(parts)) == k) if parts > 1 else table
        got = mine.orderBy("item_id", "part").toArrow()  # about SPACE_WORDS words
        feature, vectors = svd(mine, idf, rank)
        out.append(Space(idf, feature, vectors, got["item_id"].to_pylist(), [x.values.to_numpy() for x in got["words"]]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): the items found in each document."""
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text"))
    result = None
    for space in spaces(docs, benchmark):
        known = docs.sparkSession.sparkContext.broadcast(space)

        def run(part: pa.RecordBatch, known=known) -> pa.RecordBatch:
            found = sorted(known.value.search(part.column("text")).items())
            ids = part.column("doc_id").take(pa.array([k[0] for k, _ in found], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array([k[1] for k, _ in found], pa.int64()), *(pa.array([v[i] for _, v in found], pa.float64()) for i in range(3))], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        one = rows.mapInArrow(T.in_slices(run), schema)
        result = one if result is None else result.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found."""
    out = docs
    for space in spaces(docs, benchmark):
        known = docs.sparkSession.sparkContext.broadcast(space)

        def run(part: pa.RecordBatch, known=known) -> pa.RecordBatch:
            keep = np.ones(part.num_rows, bool)
            keep[[k[0] for k in known.value.search(part.column(part.num_columns - 1))]] = False
            kept = part.filter(pa.array(keep))
            return pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))

        lowered = "lowered"
        while lowered in out.columns:
            lowered += "_"
        out = out.withColumn(lowered, F.lower(out["text"])).mapInArrow(T.in_slices(run, lowered), out.schema)
    return out
